"""Paired tests over long score tables: sums in Spark, tails on the driver on K x K numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, normal_sf, shapiro, studentized_range_sf
from .series import average_rank

MIN_ROWS = 20
#: Protocols whose table of pairs the driver holds.
MAX_PROTOCOLS = 200


def bounded(df: DataFrame, most: int) -> list:
    """All rows of a small table; more than ``most`` are an error, never dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: too many protocols for a table on the driver")
    return rows


def complete_rows(scores: DataFrame, n_protocols: int) -> DataFrame:
    """scores (doc, protocol, value): documents that have a value for every protocol."""
    own = scores.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    whole = own.groupBy("doc").agg(F.count_distinct("protocol").alias("_n")).filter(F.col("_n") == n_protocols)
    return own.join(whole.select("doc"), "doc", "left_semi")


def ranked(scores: DataFrame) -> DataFrame:
    """Average ranks within each document, 1 for the best."""
    return scores.withColumn("rank", average_rank("value", ["doc"]))


def friedman_sums(scores: DataFrame) -> DataFrame:
    """Per protocol: documents and rank sum; the tie term of each document in total."""
    return ranked(scores).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank_sum"), F.sum(F.col("rank") * F.col("rank")).alias("rank_squares"))


def friedman(scores: DataFrame) -> dict:
    """Chi-square with tie correction, p, Kendall's W and the mean ranks."""
    rows = bounded(friedman_sums(scores), MAX_PROTOCOLS)
    k, n = len(rows), rows[0]["n"] if rows else 0
    if k < 2 or not n:
        return {"chi2": math.nan, "p": math.nan, "w": math.nan, "ranks": {}}
    mean = n * (k + 1) / 2
    between = sum((r["rank_sum"] - mean) ** 2 for r in rows) / n
    within = (sum(r["rank_squares"] for r in rows) - n * k * (k + 1) ** 2 / 4) / (n * (k - 1))
    chi2 = between / within if within > 0 else math.nan
    return {"chi2": chi2, "p": chi2_sf(chi2, k - 1) if within > 0 else math.nan, "w": chi2 / (n * (k - 1)), "ranks": {r["protocol"]: r["rank_sum"] / n for r in rows}}


def friedman_frame(scores: DataFrame) -> DataFrame:
    """Chi-square and Kendall's W as one row."""
    s = friedman_sums(scores).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"), F.sum("rank_sum").alias("s"), F.sum("rank_squares").alias("q"))
    k, n = F.col("k"), F.col("n")
    between = (F.col("ss") - F.col("s") * F.col("s") / k) / n
    within = (F.col("q") - n * k * (k + 1) * (k + 1) / 4) / (n * (k - 1))
    chi2 = F.try_divide(between, within)
    return s.select("n", "k", chi2.alias("chi2"), F.try_divide(chi2, n * (k - 1)).alias("kendall_w"))


def nemenyi(ranks: dict[str, float], n: int) -> dict[tuple[str, str], float]:
    """p of every pair, from the studentised range of the mean ranks."""
    k = len(ranks)
    scale = math.sqrt(k * (k + 1) / (6 * n))
    names = sorted(ranks)
    return {(a, b): studentized_range_sf(abs(ranks[a] - ranks[b]) / scale * math.sqrt(2), k) for i, a in enumerate(names) for b in names[i + 1 :]}


def letter_groups(ranks: dict[str, float], p_values: dict[tuple[str, str], float], alpha: float = 0.05) -> dict[str, set[int]]:
    """Groups of protocols that do not differ, numbered by their best mean rank."""
    sets = [frozenset(ranks)]
    for (a, b), p in p_values.items():
        if p >= alpha:
            continue
        split = [part for s in sets for part in ((s - {a}, s - {b}) if a in s and b in s else (s,))]
        sets = [s for s in set(split) if s and not any(s < other for other in split)]
    sets.sort(key=lambda s: (min(ranks[x] for x in s), sorted(s)))
    return {x: {i + 1 for i, s in enumerate(sets) if x in s} for x in ranks}


def share_group(a: set[int], b: set[int]) -> bool:
    return bool(a & b)


def pair_deltas(scores: DataFrame) -> DataFrame:
    """(a, b, doc, d) for every unordered pair of protocols; K values a document."""
    a = scores.select("doc", F.col("protocol").alias("a"), F.col("value").alias("_x"))
    b = scores.select("doc", F.col("protocol").alias("b"), F.col("value").alias("_y"))
    return a.join(b, "doc").filter("a < b").select("a", "b", "doc", (F.col("_x") - F.col("_y")).alias("d"))


def wilcoxon_sums(deltas: DataFrame) -> DataFrame:
    """Per pair: n without zeros, positive and negative rank sums, |z| with tie correction, r, median delta, ties."""
    own = deltas.withColumn("d", F.round("d", 12)).withColumn("_abs", F.abs("d"))
    nonzero = own.filter("d <> 0")
    ranks = nonzero.withColumn("_rank", average_rank("_abs", ["a", "b"], descending=False))
    ties = nonzero.groupBy("a", "b", "_abs").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy("a", "b").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    sums = ranks.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("_rank")).otherwise(0.0)).alias("minus"))
    whole = own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("median_delta"), F.avg((F.col("d") == 0).cast("double")).alias("tie_share"))
    m = F.col("m")
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("tie") / 48
    z = F.abs(F.try_divide(F.least("plus", "minus") - m * (m + 1) / 4, F.sqrt(variance)))
    return whole.join(sums, ["a", "b"], "left").join(ties, ["a", "b"], "left").select("a", "b", "n", "m", "plus", "minus", F.coalesce(z, F.lit(0.0)).alias("z"), F.coalesce(F.try_divide(z, F.sqrt(m)), F.lit(0.0)).alias("r"), "median_delta", "tie_share")


def holm(p_values: list[float]) -> list[float]:
    """Step-down adjusted p-values; not a number counts as 1."""
    p = [1.0 if math.isnan(x) else x for x in p_values]
    order, worst, out = sorted(range(len(p)), key=p.__getitem__), 0.0, [0.0] * len(p)
    for place, i in enumerate(order):
        worst = max(worst, min(1.0, (len(p) - place) * p[i]))
        out[i] = worst
    return out


def holm_column(p: str, order: list[str], by: list[str] = ()):
    """The same as a window over a table of p-values."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(p, *order))
    step = F.col(p) * (F.count(F.lit(1)).over(w) - place + 1)
    return step, w.orderBy(p, *order).rowsBetween(Window.unboundedPreceding, 0)


def with_holm(df: DataFrame, p: str, order: list[str], by: list[str] = ()) -> DataFrame:
    step, w = holm_column(p, order, by)
    return df.withColumn("_step", step).withColumn(f"{p}_holm", F.least(F.lit(1.0), F.max("_step").over(w))).drop("_step")


def wilcoxon_holm(scores: DataFrame) -> list[dict]:
    """Every pair with its two-sided normal p and the Holm-adjusted one."""
    rows = [r.asDict() for r in bounded(wilcoxon_sums(pair_deltas(scores)).orderBy("a", "b"), MAX_PROTOCOLS**2)]
    p = [2 * normal_sf(r["z"]) if r["m"] else 1.0 for r in rows]
    return [r | {"p": x, "p_holm": y} for r, x, y in zip(rows, p, holm(p))]


def cohen_d(deltas: DataFrame) -> DataFrame:
    """Mean over deviation of the differences; a deviation near 0 gives 0."""
    own = deltas.groupBy("a", "b").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    d = F.when(F.coalesce("sd", F.lit(0.0)) < 1e-12, 0.0).otherwise(F.try_divide("mean", "sd"))
    size = F.abs(F.col("d"))
    return own.withColumn("d", d).withColumn("size", F.when(size < 0.2, "desprezível").when(size < 0.5, "pequeno").when(size < 0.8, "médio").otherwise("grande"))


def ranking(scores: DataFrame) -> DataFrame:
    """Mean, deviation, quartiles, mean rank, share of 1.0 and adjusted skewness per protocol, best mean first."""
    v = F.col("value")
    own = ranked(scores).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3"),
        F.avg("rank").alias("mean_rank"), F.avg((v == 1).cast("double")).alias("share_one"), F.skewness(v).alias("_g"),
    )
    n = F.col("n")
    skew = F.when(n > 2, F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2))
    return own.withColumn("skew", skew).drop("_g").orderBy(F.desc("mean"), "protocol")


def shapiro_of(df: DataFrame, value: str, most: int = 5000, seed: int = 42) -> tuple[float, float]:
    """Shapiro-Wilk on at most ``most`` values, drawn in hash order where there are more (as the test is defined here)."""
    own = df.filter(F.col(value).isNotNull()).select(value).orderBy(F.xxhash64(value, F.lit(seed)), value).limit(most)
    return shapiro([r[0] for r in own.collect()])


def run_stats(scores: DataFrame, alpha: float = 0.05) -> dict:
    """The whole battery on complete rows: too few rows say so; three protocols or more add Friedman and Nemenyi."""
    names = [r[0] for r in bounded(scores.select("protocol").distinct(), MAX_PROTOCOLS)]
    own = complete_rows(scores, len(names))
    n = own.select("doc").distinct().count()
    if n < MIN_ROWS or len(names) < 2:
        return {"status": "insufficient", "n": n}
    out = {"status": "ok", "n": n, "pairs": wilcoxon_holm(own), "ranking": [r.asDict() for r in ranking(own).collect()]}
    if len(names) > 2:
        out["friedman"] = f = friedman(own)
        out["nemenyi"] = nemenyi(f["ranks"], n)
        out["groups"] = letter_groups(f["ranks"], out["nemenyi"], alpha)
    return out
