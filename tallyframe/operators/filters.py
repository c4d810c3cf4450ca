"""Filters: dictionaries and query texts, id sets, catalogue predicates."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_accents

_PREFIX = re.compile(r"^\s*(!=|>=|<=|==|>|<|=)\s*(.*)$", re.S)


def _literal(value):
    """Numbers in text become int (without a dot) or float."""
    if isinstance(value, str):
        try:
            return float(value) if "." in value else int(value)
        except ValueError:
            return value
    return value


def condition(column: str, value) -> Column:
    """One predicate: a list is a set, a text may begin with an operator; != keeps nulls."""
    c = F.col(column)
    if isinstance(value, (list, tuple, set)):
        return c.isin(list(value))
    if value is None:
        return c.isNull()
    m = _PREFIX.match(value) if isinstance(value, str) else None
    operator, operand = (m[1], _literal(m[2].strip())) if m else ("=", value)
    if operator == "!=":
        return ~c.eqNullSafe(F.lit(operand))
    return {"=": c == operand, "==": c == operand, ">=": c >= operand, "<=": c <= operand, ">": c > operand, "<": c < operand}[operator]


def dataset_filter(df: DataFrame, rule: dict | str | None) -> DataFrame:
    """AND of a dictionary's predicates (unknown columns raise), or a query text; a broken text warns and filters nothing."""
    if not rule:
        return df
    if isinstance(rule, dict):
        if missing := [k for k in rule if k not in df.columns]:
            raise ValueError(f"unknown columns: {missing}")
        return df.filter(reduce(lambda a, b: a & b, (condition(k, v) for k, v in rule.items())))
    try:
        out = df.filter(re.sub(r"\s*==\s*", " = ", rule))
        out.schema  # noqa: B018  analysed now
        return out
    except PySparkException as e:
        warnings.warn(f"the filter is not applied: {e}", stacklevel=2)
        return df


def id_set_filter(df: DataFrame, id_col: str, *id_sets: DataFrame) -> DataFrame:
    """Rows whose id, as trimmed text, is in every set (first column)."""
    for ids in id_sets:
        own = ids.select(F.trim(F.col(ids.columns[0]).cast("string")).alias("_id")).distinct()
        df = df.join(own, F.trim(F.col(id_col).cast("string")) == F.col("_id"), "left_semi")
    return df


def year_in(date, years) -> Column:
    return F.substring(F.col(date), 1, 4).isin([str(y) for y in years])


def class_is(column: str, name: str) -> Column:
    return F.col(column).rlike(rf"\b{re.escape(name)}\b")


def type_is(column: str, kind: str) -> Column:
    return F.lower(fold_accents(column)) == F.lower(fold_accents(F.lit(kind)))


def any_identifier(*conditions: Column) -> Column:
    """Identifier filters hold when any of them does."""
    return reduce(lambda a, b: a | b, conditions)


def query_map(index: DataFrame, filters: list[Column] = (), identifiers: list[Column] = (), equal: dict | None = None) -> DataFrame:
    """All filters, any identifier, and equal values."""
    conditions = [*filters, *([any_identifier(*identifiers)] if identifiers else []), *(F.col(k) == v for k, v in (equal or {}).items())]
    return index.filter(reduce(lambda a, b: a & b, conditions)) if conditions else index


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which some column is neither null nor "", [] or {}."""
    return df.filter(reduce(lambda a, b: a | b, (~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]", "{}", '""') for c in columns)))


def successful(df: DataFrame) -> DataFrame:
    return df.filter((F.coalesce(F.trim("erro"), F.lit("")) == "") & (F.coalesce(F.trim("resposta"), F.lit("")) != ""))


def failed(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.trim("erro"), F.lit("")) != "")


def select_protocols(wanted: list[str], labels: list[str], aliases: dict[str, str]) -> tuple[list[str], list[str]]:
    """Labels chosen by label, then by alias, without case, in declared order; and what was not found."""
    by_label = {x.lower(): x for x in labels}
    by_alias = {aliases.get(x, x).lower(): x for x in labels}
    found = {w: by_label.get(w.lower()) or by_alias.get(w.lower()) for w in wanted}
    return [x for x in labels if x in found.values()], [w for w, x in found.items() if x is None]
