"""Frames behind charts and reports, and the small filters and lookups around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, mean, sd, min, quartiles and max of its numbers; nulls do not count."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns))))
    quarter = lambda q: F.percentile("_v", F.lit(q))
    return long.groupBy("column").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.min("_v").alias("min"), quarter(0.25).alias("q1"), quarter(0.5).alias("median"), quarter(0.75).alias("q3"), F.max("_v").alias("max")
    )


def box_statistics(df: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, the last values within ``reach`` quartile distances as whiskers, and the number of values beyond."""
    own = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), *(F.percentile(value, F.lit(q)).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    low, high = F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    # the fences come from the groups, of which there are as many as boxes on a chart
    inside = df.join(own.select(*by, low.alias("_low"), high.alias("_high")), by).filter(v.isNotNull())
    kept = v.between(F.col("_low"), F.col("_high"))
    ends = inside.groupBy(*by).agg(F.min(F.when(kept, v)).alias("whisker_low"), F.max(F.when(kept, v)).alias("whisker_high"), F.count_if(~kept).alias("outliers"))
    return own.join(ends, by)


def heatmap(df: DataFrame, row: str, column: str, columns: list, cell: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(cell)


def bars_by_type(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """n, sum and mean per value column (its name is the type) and group."""
    long = df.select(by, F.inline(F.array(*(F.struct(F.lit(c).alias("type"), F.col(c).cast("double").alias("_v")) for c in columns))))
    return long.groupBy("type", by).agg(F.count("_v").alias("n"), F.sum("_v").alias("sum"), F.avg("_v").alias("mean"))


def loss_table(train: DataFrame, evaluation: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of either log; the other's losses are null there."""
    return train.join(evaluation, keys, "full")


def token_evolution(log: DataFrame, by: list[str], order: str, tokens: str, instances: Column | None = None) -> DataFrame:
    """Running sums of tokens and instances in the order of the steps."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("sum_tokens", F.sum(tokens).over(w)).withColumn("sum_instances", F.sum(F.lit(1) if instances is None else instances).over(w))


def sort_results(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(key)


def sort_split(df: DataFrame, difficulty: str, key: str) -> DataFrame:
    return df.orderBy(difficulty, key)


def limit_items(df: DataFrame, order: list, most: int | None) -> DataFrame:
    """The first ``most`` rows in the order given; all without a number."""
    return df if most is None else df.orderBy(*order).limit(most)


def pair_extraction_join(pairs: DataFrame, records: DataFrame, key: str, counts: list[str], per_thousand: bool = True) -> DataFrame:
    """Token and judge records of each pair's id; counts in thousands where asked; null without a record."""
    own = records.select(key, *((F.col(c) / 1000 if per_thousand else F.col(c)).alias(c) for c in counts))
    return pairs.join(own, key, "left")


def process_filter(df: DataFrame, wanted: DataFrame, record: str, process: str, klass: str, date: str, kind: str) -> DataFrame:
    """Rows whose record or process is wanted; wanted (key, date, kind): a date or kind that is null holds for all.

    A blank process is class and record.  Wanted keys become one row each, so no row of ``df`` is doubled.
    """
    marks = wanted.filter(~is_blank("key")).groupBy(F.upper(F.trim("key")).alias("_key")).agg(F.collect_set(F.struct("date", "kind")).alias("_marks"))
    blank = is_blank(process)
    keys = {"_record": F.trim(F.col(record).cast("string")), "_process": F.upper(F.trim(F.when(blank & ~is_blank(klass), F.concat_ws(" ", klass, F.col(record).cast("string"))).otherwise(F.col(process))))}
    out = df.select(F.struct(*df.columns).alias("_row"), *(c.alias(k) for k, c in keys.items()), F.col(date).alias("_date"), F.upper(F.trim(kind)).alias("_kind"))
    for k in keys:
        out = out.join(marks.select(F.col("_key").alias(k), F.col("_marks").alias(f"_m{k}")), k, "left")
    holds = lambda m: (m["date"].isNull() | (m["date"] == F.col("_date"))) & (m["kind"].isNull() | (F.upper(F.trim(m["kind"])) == F.col("_kind")))
    found = reduce(lambda a, b: a | b, (F.coalesce(F.exists(f"_m{k}", holds), F.lit(False)) for k in keys))
    return out.filter(found).select("_row.*")


def document_filter(df: DataFrame, wanted: DataFrame, sequence: str, key: str, fulltext: DataFrame) -> DataFrame:
    """Rows whose sequence is wanted, or whose full-text record's is; wanted (sequence), fulltext (key, sequence)."""
    ids = wanted.select(F.trim(F.col(sequence).cast("string")).alias("_seq")).filter("_seq is not null").distinct()
    by_record = fulltext.select(F.col(key).alias("_key"), F.trim(F.col(sequence).cast("string")).alias("_seq")).join(ids, "_seq", "left_semi").select("_key").distinct()
    out = df.select(F.struct(*df.columns).alias("_row"), F.trim(F.col(sequence).cast("string")).alias("_seq"), F.col(key).alias("_key"))
    out = out.join(ids.withColumn("_own", F.lit(True)), "_seq", "left").join(by_record.withColumn("_by", F.lit(True)), "_key", "left")
    return out.filter(F.coalesce("_own", "_by", F.lit(False))).select("_row.*")


def fold_filter(df: DataFrame, fold: str, text: str, equal: dict, columns: list[str], low: int = 1, high: int = 10) -> DataFrame:
    """Folds of a range, equal columns, a text that is not blank; three columns of them."""
    same = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in equal.items()), F.lit(True))
    return df.filter(F.col(fold).between(low, high) & same & ~is_blank(text)).select(*columns)


def long_answers(df: DataFrame, answer: str, over: int = 10) -> DataFrame:
    return df.filter(F.length(answer) > over)


def already_exported(df: DataFrame, text: str, json: str, least: int = 10, parse: bool = False) -> DataFrame:
    """Rows whose text and JSON both have ``least`` bytes, and parse where asked; what follows a whole JSON value is not looked at."""
    whole = (F.octet_length(text) >= least) & (F.octet_length(json) >= least)
    return df.filter(whole & F.try_parse_json(json).isNotNull() if parse else whole)
