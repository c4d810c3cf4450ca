"""Dates kept as text, and helpers over timestamps; one session zone (UTC) is assumed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyyMMdd")
WEEKDAYS = ("segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo")
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def parse_datetime(c) -> Column:
    """The first of eight formats that fits; else null."""
    x = F.trim(col(c))
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in FORMATS))


def is_datetime(c) -> Column:
    return parse_datetime(c).isNotNull()


def date_of_mirror(c) -> Column:
    """DD/MM/YYYY anywhere in the text -> YYYYMMDD, else ""."""
    parts = [F.regexp_extract(col(c), r"(\d{2})/(\d{2})/(\d{4})", k) for k in (3, 2, 1)]
    return F.concat(*parts)


def date_of_fulltext(c) -> Column:
    """ISO text or epoch milliseconds (UTC) -> YYYYMMDD, else ""."""
    x = F.trim(col(c).cast("string"))
    millis = F.when(x.rlike(r"^\d{10,}$"), F.date_format(F.timestamp_millis(x.cast("bigint")), "yyyyMMdd"))
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(F.substring(x, 1, 10), "-", ""))
    return F.coalesce(millis, iso, F.lit(""))


def normalise_date(c) -> Column:
    """YYYYMMDD of any known format; unknown text stays."""
    return F.coalesce(F.date_format(parse_datetime(c), "yyyyMMdd"), col(c))


def composite_key(record, date, kind) -> Column:
    return F.concat_ws(".", F.trim(col(record)), col(date), F.upper(F.trim(col(kind))))


def compare_dates(a, operator: str, b) -> Column:
    x, y = normalise_date(a), normalise_date(b)
    return {"=": x == y, "==": x == y, "<>": x != y, "!": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[operator]


def add_days(c, days: int) -> Column:
    return F.date_add(col(c), days)


def hour_between(c, start: str = "00:00", end: str = "23:59") -> Column:
    """Inclusive; an end before the start wraps midnight."""
    x = F.date_format(col(c), "HH:mm")
    return ((x >= start) & (x <= end)) if start <= end else ((x >= start) | (x <= end))


def hour_in(c, hours: list[int]) -> Column:
    return F.hour(col(c)).isin(hours)


def weekday_name(c, short: bool = False) -> Column:
    names = [n[:3] for n in WEEKDAYS] if short else WEEKDAYS
    return F.element_at(F.array(*map(F.lit, names)), F.weekday(col(c)) + 1)


def seconds_to_hms(c) -> Column:
    s = col(c).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def long_date(c) -> Column:
    return F.concat(F.date_format(col(c), "dd"), F.lit(" de "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(col(c))), F.lit(" de "), F.date_format(col(c), "yyyy"))
