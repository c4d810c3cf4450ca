"""Rater agreement: notes of several raters over documents and sources."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import binomial_two_sided, chi2_sf, normal_quantile

LONG_SCHEMA = "group string, rater int, doc string, source string, note int, problems array<string>, failed boolean, reason string"


def normalise_rater(df: DataFrame, rater: int, group: str) -> DataFrame:
    """Rows (chave doc_source, resposta JSON, erro) -> the long table; notes are rounded half to even."""
    answer = F.try_parse_json("resposta")
    raw = F.try_variant_get(answer, "$.nota", "double")
    blank = F.coalesce(F.trim("resposta"), F.lit("")) == ""
    reason = F.when(F.coalesce(F.trim("erro"), F.lit("")) != "", F.col("erro")).when(blank, "empty").when(answer.isNull(), "not JSON").when(raw.isNull(), "no note")
    return df.select(
        F.lit(group).alias("group"), F.lit(rater).alias("rater"), F.regexp_extract("chave", r"^(.*)_([^_]+)$", 1).alias("doc"), F.regexp_extract("chave", r"^(.*)_([^_]+)$", 2).alias("source"),
        F.when(reason.isNull(), F.bround(raw).cast("int")).alias("note"), F.coalesce(F.try_variant_get(answer, "$.problemas", "array<string>"), F.array().cast("array<string>")).alias("problems"),
        reason.isNotNull().alias("failed"), reason.alias("reason"),
    )


def failure_table(df: DataFrame, source: str, rater: str, failed: Column) -> DataFrame:
    """n, failures and rate per source and rater, with the totals of both (grouping sets)."""
    return df.cube(source, rater).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures")).withColumn("rate_pct", F.round(100 * F.col("failures") / F.col("n"), 3))


def paired_discard(df: DataFrame, doc: str, cells: list[str], n_cells: int) -> DataFrame:
    from .joins import divide

    return divide(df, doc, cells, n_cells)


def median_pivot(df: DataFrame, doc: list[str], by: str, values: list, note: str) -> DataFrame:
    """Median note per item and column; complete rows only."""
    return df.groupBy(*doc).pivot(by, values).agg(F.median(note)).dropna(subset=[str(v) for v in values])


def ambiguous(df: DataFrame, item: list[str], note: str, limit: float = 2) -> DataFrame:
    """Items whose notes lie more than ``limit`` apart, widest first."""
    return df.groupBy(*item).agg((F.max(note) - F.min(note)).alias("amplitude")).filter(F.col("amplitude") > limit).orderBy(F.desc("amplitude"), *item)


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """A proportion with its Wilson interval; null without trials."""
    z = normal_quantile((1 + confidence) / 2)
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    return p, centre - half, centre + half


def source_descriptives(df: DataFrame, source: str, note: str, floor: float = 3) -> DataFrame:
    own = df.groupBy(source).agg(
        F.count(note).alias("n"), F.avg(note).alias("mean"), F.median(note).alias("median"), F.stddev_samp(note).alias("sd"),
        F.percentile(note, F.lit(0.25)).alias("q1"), F.percentile(note, F.lit(0.75)).alias("q3"), F.min(note).alias("min"), F.max(note).alias("max"), F.count_if(F.col(note) >= floor).alias("k"),
    )
    p, low, high = wilson(F.col("k"), F.col("n"))
    return own.withColumn("share", p).withColumn("low", low).withColumn("high", high).drop("k")


def confusion(df: DataFrame, a: str, b: str, categories: list[int]) -> DataFrame:
    """Counts over the whole k x k grid of categories."""
    k = len(categories)
    grid = df.sparkSession.range(k * k).select(F.element_at(F.array(*map(F.lit, categories)), (F.col("id") / k).cast("int") + 1).alias("a"), F.element_at(F.array(*map(F.lit, categories)), (F.col("id") % k).cast("int") + 1).alias("b"))
    counts = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counts, ["a", "b"], "left").na.fill(0, ["n"])


def quadratic_weight(a: Column, b: Column, k: int) -> Column:
    return 1 - ((a - b) / (k - 1)) ** 2


def cohen_weighted(df: DataFrame, a: str, b: str, categories: list[int]) -> DataFrame:
    """Quadratic-weighted agreement, expected agreement and kappa; the expected part needs the marginals' moments only."""
    k, lo, hi = len(categories), min(categories), max(categories)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    span = float(hi - lo) or 1.0
    own = df.filter(x.isNotNull() & y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((x - y) * (x - y)).alias("d"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy")
    )
    po = 1 - F.col("d") / span**2
    pe = 1 - (F.col("xx") + F.col("yy") - 2 * F.col("mx") * F.col("my")) / span**2
    return own.select("n", po.alias("p_o"), pe.alias("p_e"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))


def fleiss_weighted(df: DataFrame, item: list[str], note: str, categories: list[int]) -> DataFrame:
    """Quadratic-weighted agreement of m raters per item, from each item's counts and moments."""
    span = float(max(categories) - min(categories)) or 1.0
    v = F.col(note).cast("double")
    per = df.filter(v.isNotNull()).groupBy(*item).agg(F.count(F.lit(1)).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).filter("m > 1")
    # mean squared difference of two different raters of the item
    within = 2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") * (F.col("m") - 1))
    own = per.agg(F.count(F.lit(1)).alias("n_items"), F.avg(within).alias("d"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    po = 1 - F.col("d") / span**2
    pe = 1 - 2 * (F.col("q") / F.col("m") - (F.col("s") / F.col("m")) ** 2) / span**2
    return own.select("n_items", po.alias("p_o"), pe.alias("p_e"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))


def band(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The first name whose limit the value is under."""
    return reduce(lambda c, x: c.when(value < x[0], x[1]), limits, F.when(value.isNull() | F.isnan(value), None)).otherwise(last)


KAPPA_BANDS = [(0.21, "nenhuma"), (0.40, "mínima"), (0.60, "fraca"), (0.80, "moderada"), (0.90, "forte")]
EFFECT_BANDS = [(0.1, "desprezível"), (0.3, "pequeno"), (0.5, "médio")]


def kappa_band(v: Column) -> Column:
    return band(v, KAPPA_BANDS, "quase perfeita")


def effect_band(v: Column) -> Column:
    return band(F.abs(v), EFFECT_BANDS, "grande")


def binary_metrics(df: DataFrame, reference: Column, test: Column) -> DataFrame:
    """TP, TN, FP, FN, accuracy, sensitivity, specificity; null where a denominator is 0."""
    own = df.agg(F.count_if(reference & test).alias("tp"), F.count_if(~reference & ~test).alias("tn"), F.count_if(~reference & test).alias("fp"), F.count_if(reference & ~test).alias("fn"))
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return own.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), total)).withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("specificity", F.try_divide("tn", F.col("tn") + F.col("fp")))


def mcnemar(df: DataFrame, a: Column, b: Column) -> dict[str, float]:
    """Discordant counts and the p-value: exact under 25 discordant pairs, else chi-square with continuity correction."""
    r = df.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c")).first()
    n = r["b"] + r["c"]
    p = 1.0 if not n else binomial_two_sided(r["b"], n) if n < 25 else chi2_sf((abs(r["b"] - r["c"]) - 1) ** 2 / n, 1)
    return {"b": r["b"], "c": r["c"], "p": p}


def mcnemar_statistic(df: DataFrame, a: Column, b: Column) -> DataFrame:
    own = df.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    d = F.abs(F.col("b") - F.col("c")) - 1
    return own.withColumn("statistic", F.try_divide((d * d).cast("double"), F.col("b") + F.col("c")))


def problem_frequency(df: DataFrame, source: str, problems: str) -> DataFrame:
    """Counts per label and source over the exploded labels."""
    return df.select(source, F.explode(problems).alias("problem")).groupBy(source, "problem").agg(F.count(F.lit(1)).alias("n"))


def evaluation_cost(df: DataFrame, by: list[str], tokens: str, seconds: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(tokens).alias("mean_tokens"), F.sum(tokens).alias("sum_tokens"), F.avg(seconds).alias("mean_seconds"), F.sum(seconds).alias("sum_seconds"))


def judge_verdict(kappa: float, wilcoxon_p: float, mcnemar_p: float, bias: float, margin: float = math.nan) -> str:
    """VALIDADO when agreement is high and both tests see no difference; COM RESSALVA when only a small bias remains."""
    if kappa >= 0.60 and wilcoxon_p > 0.05 and mcnemar_p > 0.05:
        return "VALIDADO"
    return "VALIDADO COM RESSALVA" if kappa >= 0.60 and not math.isnan(margin) and abs(bias) < margin else "NÃO VALIDADO"


def block_bootstrap(df: DataFrame, block: str, sums: dict[str, Column], statistic: Column, replicas: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic of sums over resampled blocks (documents).

    Each block is one row of sufficient statistics; its draws in a replica are a
    Poisson(1) count from a hash of block, replica and seed, so no draw needs
    the other blocks and replicas are summed with map-side partial sums.
    """
    per = df.groupBy(block).agg(*(e.alias(k) for k, e in sums.items()))
    u = (F.pmod(F.xxhash64(F.col(block), F.col("replica"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cumulative, term, times = 0.0, math.exp(-1), F.lit(0)
    for k in range(12):
        cumulative += term
        times = times + F.when(u > cumulative, 1).otherwise(0)
        term /= k + 1
    drawn = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("replica")).withColumn("_k", times).filter("_k > 0")
    values = drawn.groupBy("replica").agg(*(F.sum(F.col(k) * F.col("_k")).alias(k) for k in sums)).select(statistic.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    tail = (1 - confidence) / 2
    point = per.agg(F.count(F.lit(1)).alias("n_blocks"), *(F.sum(k).alias(k) for k in sums)).select("n_blocks", statistic.alias("point"))
    bounds = values.agg(F.percentile("v", F.lit(tail)).alias("low"), F.percentile("v", F.lit(1 - tail)).alias("high"), F.count(F.lit(1)).alias("_valid"))
    enough = (F.col("n_blocks") >= 3) & (F.col("_valid") >= replicas / 2)
    return point.crossJoin(bounds).select("n_blocks", "point", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))
