"""Validation of judges: agreement inside a group of raters, and of every judge with a reference."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import binomial_two_sided, chi2_sf, normal_sf
from . import agreement, frequentist

KAPPA_LIMIT, ALPHA, FLOOR = 0.60, 0.05, 3
MAX_JUDGES = 1000


def scale_categories(df: DataFrame, note: str, scale: tuple[int, int] = (1, 4)) -> DataFrame:
    """Every category of the scale, widened by notes outside it."""
    ends = df.agg(F.least(F.lit(scale[0]), F.floor(F.min(note)).cast("int")).alias("a"), F.greatest(F.lit(scale[1]), F.floor(F.max(note)).cast("int")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("category"))


def long_by_group(df: DataFrame, item: list[str], group: str, groups: list[str], note: str) -> DataFrame:
    """Items with one column per group, its median note; complete rows only."""
    return agreement.median_pivot(df, item, group, groups, note)


def rater_matrix(df: DataFrame, item: list[str], rater: str, raters: list, note: str) -> DataFrame:
    """Items with a column per rater; items that miss a rater are left out."""
    return df.groupBy(*item).pivot(rater, raters).agg(F.first(note)).dropna(subset=[str(x) for x in raters])


def kappa(x: Column, y: Column, span: float) -> Column:
    """Quadratic-weighted kappa of a group from the moments of its pairs; 1 where chance agrees in full."""
    observed = 1 - F.avg((x - y) * (x - y)) / span**2
    expected = 1 - (F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)) / span**2
    return F.coalesce(F.try_divide(observed - expected, 1 - expected), F.lit(1.0))


def internal_agreement(df: DataFrame, item: list[str], rater: str, raters: list, note: str, categories: list[int]) -> DataFrame:
    """One row: items, observed and expected agreement, kappa and its band, share of equal notes and of notes at most 1 apart, approval."""
    matrix = rater_matrix(df, item, rater, raters, note)
    cells = [F.col(str(x)) for x in raters]
    spread = F.greatest(*cells) - F.least(*cells)
    shares = matrix.agg(F.avg((spread == 0).cast("double")).alias("exact"), F.avg((spread <= 1).cast("double")).alias("within_1"))
    long = matrix.select(*item, F.explode(F.array(*cells)).alias("_note"))
    whole = agreement.fleiss_weighted(long, item, "_note", categories)
    # both sides are one row
    return whole.crossJoin(shares).withColumn("band", agreement.kappa_band(F.col("kappa"))).withColumn("approved", F.col("kappa") >= KAPPA_LIMIT)


def pair_agreement(df: DataFrame, item: list[str], rater: str, raters: list, note: str, categories: list[int]) -> DataFrame:
    """Per pair of raters: n, weighted kappa, share of equal notes."""
    matrix = rater_matrix(df, item, rater, raters, note)
    of = lambda x: F.col(str(x)).cast("double")
    pairs = matrix.select(F.inline(F.array(*(F.struct(F.lit(str(a)).alias("a"), F.lit(str(b)).alias("b"), of(a).alias("_x"), of(b).alias("_y")) for a, b in combinations(raters, 2)))))
    span = float(max(categories) - min(categories)) or 1.0
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), kappa(F.col("_x"), F.col("_y"), span).alias("kappa"), F.avg((F.col("_x") == F.col("_y")).cast("double")).alias("exact"))


def internal_severity(df: DataFrame, item: list[str], rater: str, raters: list, note: str) -> DataFrame:
    """Friedman with raters as treatments, a row per rater: mean, mean rank, and the test's n, chi-square, degrees and p."""
    matrix = rater_matrix(df, item, rater, raters, note)
    cells = F.inline(F.array(*(F.struct(F.lit(str(x)).alias("protocol"), F.col(str(x)).cast("double").alias("value")) for x in raters)))
    scores = matrix.select(F.to_json(F.struct(*item)).alias("doc"), cells)
    ranks = frequentist.ranked(scores).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.sum("rank").alias("_r"), F.sum(F.col("rank") * F.col("rank")).alias("_q"))
    rows, k = frequentist.bounded(ranks.orderBy("protocol"), MAX_JUDGES), len(raters)
    out = []
    for row in rows:
        n, total = row["n"], sum(x["_r"] for x in rows)
        between = (sum(x["_r"] ** 2 for x in rows) - total**2 / k) / n
        within = (sum(x["_q"] for x in rows) - n * k * (k + 1) ** 2 / 4) / (n * (k - 1))
        chi2 = between / within if within else None
        out.append((row["protocol"], row["mean"], row["_r"] / n, n, chi2, k - 1, None if chi2 is None else chi2_sf(chi2, k - 1)))
    return df.sparkSession.createDataFrame(out, "rater string, mean double, mean_rank double, n bigint, chi2 double, degrees int, p double")


def source_contrasts(df: DataFrame, doc: str, source: str, sources: list[str], note: str) -> DataFrame:
    """Every pair of sources over the complete documents: Wilcoxon sums, p, Holm's p, significance and band of the effect."""
    whole = agreement.median_pivot(df, [doc], source, sources, note)
    scores = whole.select(F.col(doc).alias("doc"), F.inline(F.array(*(F.struct(F.lit(x).alias("protocol"), F.col(x).cast("double").alias("value")) for x in sources))))
    rows = frequentist.wilcoxon_holm(scores)
    out = [(x["a"], x["b"], int(x["m"] or 0), float(x["plus"] or 0), float(x["minus"] or 0), float(x["p"]), float(x["p_holm"]), x["p_holm"] < ALPHA) for x in rows]
    found = df.sparkSession.createDataFrame(out, "a string, b string, n bigint, plus double, minus double, p double, p_holm double, significant boolean")
    effect = F.try_divide(F.col("plus") - F.col("minus"), F.col("plus") + F.col("minus"))
    return found.withColumn("effect", effect).withColumn("band", agreement.effect_band(effect))


def judge_measures(long: DataFrame, reference: str, judges: list[str], categories: list[int], floor: float = FLOOR) -> DataFrame:
    """Per judge against the reference: n, kappa, bias, and the documents only one of both finds adequate."""
    cells = [F.struct(F.lit(j).alias("judge"), F.col(j).cast("double").alias("_x"), F.col(reference).cast("double").alias("_y")) for j in judges]
    x, y = F.col("_x"), F.col("_y")
    span = float(max(categories) - min(categories)) or 1.0
    return long.select(F.inline(F.array(*cells))).filter(x.isNotNull() & y.isNotNull()).groupBy("judge").agg(
        F.count(F.lit(1)).alias("n"), kappa(x, y, span).alias("kappa"), F.avg(x - y).alias("bias"), F.count_if((x >= floor) & (y < floor)).alias("only_judge"), F.count_if((x < floor) & (y >= floor)).alias("only_reference")
    )


def validate_judges(long: DataFrame, item: list[str], reference: str, judges: list[str], categories: list[int], margin: float = 0.5) -> DataFrame:
    """The measures of every judge, the p of Wilcoxon on notes and of McNemar on decisions, and the verdict."""
    deltas = long.select(F.to_json(F.struct(*item)).alias("doc"), F.inline(F.array(*(F.struct(F.lit(j).alias("a"), F.lit(reference).alias("b"), (F.col(j) - F.col(reference)).cast("double").alias("d")) for j in judges))))
    sums = {r["a"]: r for r in frequentist.bounded(frequentist.wilcoxon_sums(deltas.filter("d is not null")), MAX_JUDGES)}
    out = []
    for r in frequentist.bounded(judge_measures(long, reference, judges, categories).orderBy("judge"), MAX_JUDGES):
        w, n = sums.get(r["judge"]), r["only_judge"] + r["only_reference"]
        p_notes = 2 * normal_sf(w["z"]) if w and w["m"] else 1.0
        p_decisions = 1.0 if not n else binomial_two_sided(r["only_judge"], n) if n < 25 else chi2_sf((abs(r["only_judge"] - r["only_reference"]) - 1) ** 2 / n, 1)
        out.append((*r, float(p_notes), float(p_decisions), agreement.judge_verdict(r["kappa"], p_notes, p_decisions, r["bias"], margin)))
    return long.sparkSession.createDataFrame(out, "judge string, n bigint, kappa double, bias double, only_judge bigint, only_reference bigint, p_notes double, p_decisions double, verdict string")
