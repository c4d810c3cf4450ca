"""Joins: pairing, consistency, catalogues, as-of and ranges, divisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_input_output(inputs: DataFrame, outputs: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Inner join by id; strict raises when an input has no output."""
    if strict and not inputs.join(outputs, key, "left_anti").isEmpty():
        raise ValueError("inputs without an output")
    return inputs.join(outputs, key)


def split_consistency(split: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """Ids that only one side has."""
    only = lambda a, b, name: a.select(key).join(b.select(key), key, "left_anti").withColumn("side", F.lit(name))
    return only(split, pairs, "split").unionByName(only(pairs, split, "pairs"))


def consolidate(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Full outer join of all tables on the key, their other columns prefixed."""
    out = None
    for name, df in tables.items():
        own = df.select(key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key))
        out = own if out is None else out.join(own, key, "full_outer")
    return out


def cross_catalogues(mirror: DataFrame, fulltext: DataFrame, key: str = "id_mapa") -> DataFrame:
    """Mirror rows with the full text of their key, and whether there is one."""
    own = fulltext.withColumn("_there", F.lit(True))
    return mirror.join(own, key, "left").withColumn("tem_integra", F.col("_there").isNotNull()).drop("_there")


def asof_backward(left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """Each left row with the values of the last right row whose ``on`` is not later.

    One shuffle by ``by`` and one sorted pass over both sides; no range join.
    """
    own = [c for c in left.columns if c not in (*by, on)]
    a = left.select(*by, on, F.lit(1).alias("_side"), F.struct(*own).alias("_left") if own else F.lit(None).alias("_left"), F.lit(None).alias("_right"))
    packed = F.struct(*values)
    b = right.select(*by, on, F.lit(0).alias("_side"), F.lit(None).alias("_left"), packed.alias("_right"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*by, on, *([F.col(f"_left.{c}").alias(c) for c in own]), *(F.col(f"_last.{v}").alias(v) for v in values))


def span_lookup(points: DataFrame, spans: DataFrame, on: str, start: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """The values of the last span that starts at or before each point."""
    return asof_backward(points, spans.withColumnRenamed(start, on), on, values, by)


def range_join(points: DataFrame, spans: DataFrame, on: str, start: str, end: str) -> DataFrame:
    """Points with the spans [start, end) that hold them, over equal-width cells of the spans' mean width.

    Both sides meet on a cell; a span is repeated once per cell that it covers, so a wide range stays an equi-join.
    """
    width = spans.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1
    width = max(float(width), 1e-9)
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_cell", F.floor(F.col(on) / width)).join(cells, "_cell").filter((F.col(on) >= F.col(start)) & (F.col(on) < F.col(end))).drop("_cell")


def divide(df: DataFrame, item: str, cells: list[str], n_cells: int) -> DataFrame:
    """Rows of the items that have every combination of the cells (relational division)."""
    whole = df.select(item, *cells).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_cells)
    return df.join(whole.select(item), item, "left_semi")


def group_intersection(df: DataFrame, item: list[str], group: str, n_groups: int) -> DataFrame:
    """Items that every group has."""
    return df.select(*item, group).distinct().groupBy(*item).agg(F.count(F.lit(1)).alias("n_groups")).filter(F.col("n_groups") == n_groups).select(*item)


def compare_copies(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column, the equal and different values over the common keys; nulls are equal."""
    both = a.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns)).join(b.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns)), key)
    same = lambda c: F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    sums = both.agg(*(F.count_if(same(c)).alias(f"{c}_equal") for c in columns), *(F.count_if(~same(c)).alias(f"{c}_different") for c in columns))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_equal").alias("equal"), F.col(f"{c}_different").alias("different")) for c in columns))))


def all_pairs(items: DataFrame, name: str, order: str, limit: int = 10_000) -> DataFrame:
    """Unordered pairs i < j of a small list, such as protocols; its size is checked."""
    if items.count() > limit:
        raise ValueError("all pairs are for short lists")
    a = items.select(F.col(name).alias("a"), F.col(order).alias("_i"))
    b = items.select(F.col(name).alias("b"), F.col(order).alias("_j"))
    return a.join(F.broadcast(b), F.col("_i") < F.col("_j")).drop("_i", "_j")


def first_wins(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of each key; ``copy`` counts from 1, so that later rows can be listed too."""
    return df.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
