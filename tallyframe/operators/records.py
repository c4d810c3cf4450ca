"""Side tables of extractions: tokens, judges, observability, field sizes; and columns of wide imports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFIXES = ("P", "R", "F1", "SIM", "nota", "explicacao")


def _number(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, "bigint") for p in paths))


def token_summary(df: DataFrame, text: str = "json") -> DataFrame:
    """Input, output, reasoning, cache and total tokens of usage objects in any of the known places.

    The total is at least input + output + reasoning.
    """
    v = F.try_parse_json(text)
    places = ("$.total_geral", "$.total", "$.tokens", "$.usage", "$")
    get = lambda *names: F.coalesce(_number(v, *(f"{p}.{n}" for p in places for n in names)), F.lit(0))
    i, o, r, c = get("input", "prompt_tokens"), get("output", "completion_tokens"), get("reason", "reasoning_tokens"), get("cache", "cached_tokens")
    total = F.greatest(get("total_tokens", "total"), i + o + r)
    return df.select(*(x for x in df.columns if x != text), i.alias("input"), o.alias("output"), r.alias("reason"), c.alias("cache"), total.alias("total"))


def judge_records(df: DataFrame, text: str = "json") -> DataFrame:
    """(.., field, p, r, f1, nota, explanation): the whole answer and each field; a missing F1 is the harmonic mean."""
    v = F.try_parse_json(text)
    num = lambda x, n: F.try_variant_get(x, f"$.{n}", "double")
    keys = [c for c in df.columns if c != text]
    fields = F.coalesce(F.from_json(F.to_json(F.try_variant_get(v, "$.metricas_por_campo", "variant")), "map<string,struct<precision:double,recall:double,f1:double>>"), F.create_map().cast("map<string,struct<precision:double,recall:double,f1:double>>"))
    whole = F.struct(F.lit("(global)").alias("field"), num(v, "precision").alias("p"), num(v, "recall").alias("r"), num(v, "f1").alias("f"), num(v, "nota").alias("nota"), F.try_variant_get(v, "$.explicacao", "string").alias("explanation"))
    each = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("field"), e["value"]["precision"].alias("p"), e["value"]["recall"].alias("r"), e["value"]["f1"].alias("f"), F.lit(None).cast("double").alias("nota"), F.lit(None).cast("string").alias("explanation")))
    rows = df.select(*keys, F.inline(F.concat(F.array(whole), each)))
    harmonic = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return rows.select(*keys, "field", "p", "r", F.when(F.coalesce("f", F.lit(0.0)) == 0, harmonic).otherwise(F.col("f")).alias("f1"), "nota", "explanation")


def observability_rollup(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps (.., agent, idx, seconds, iteration, revised, ok) -> per agent sums, largest iteration, any revision, last success."""
    return steps.groupBy(*keys, "agent").agg(F.sum("seconds").alias("SEG"), F.max("iteration").alias("IT"), F.bool_or("revised").alias("REV"), F.max_by("ok", "idx").alias("OK"), F.count(F.lit(1)).alias("QTD"))


def field_metrics(df: DataFrame, text: str = "json") -> DataFrame:
    """(.., QTD fields that are not empty; field sizes): length of each top-level field as text."""
    v = F.try_parse_json(text)
    entries = F.map_entries(F.coalesce(F.from_json(F.to_json(v), "map<string,string>"), F.create_map().cast("map<string,string>")))
    full = F.filter(entries, lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "[]", "{}"))
    keys = [c for c in df.columns if c != text]
    return df.select(*keys, F.size(full).alias("QTD"), F.map_from_entries(F.transform(full, lambda e: F.struct(e["key"], F.length(e["value"])))).alias("BYTES"))


def count_keys(text: str) -> Column:
    """Keys of all objects of a JSON text: quoted names before a colon, outside string values."""
    plain = F.regexp_replace(F.to_json(F.try_parse_json(text)), r'\\.', "")
    return F.coalesce(F.regexp_count(plain, F.lit(r'"[^"]*":')), F.lit(0))


def drop_unused(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns that hold a value other than null, 0 and "" somewhere; one aggregation over the table."""
    other = [c for c in df.columns if c not in keep]
    used = df.agg(*(F.bool_or(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0")).alias(c) for c in other)).first() if other else {}
    return df.select(*keep, *(c for c in other if used[c]))


def order_columns(columns: list[str], key: str, models: list[str], kinds: list[str]) -> list[str]:
    """The key, then each model's columns in the order of the kinds, then the rest."""
    wanted = [f"{m}_{k}" for m in models for k in kinds if f"{m}_{k}" in columns]
    return [key, *wanted, *(c for c in columns if c not in (key, *wanted))]


def parse_metric_column(name: str, models: list[str], metrics: tuple[str, ...]) -> tuple[str, str, str, str] | None:
    """(model, field, metric, suffix) of a wide column; the longest model name that fits wins."""
    for model in sorted(models, key=len, reverse=True):
        if name.startswith(f"{model}_"):
            m = re.fullmatch(rf"(.+)_({'|'.join(sorted(metrics, key=len, reverse=True))})_({'|'.join(SUFFIXES)})", name[len(model) + 1 :])
            if m:
                return model, m[1], m[2], m[3]
    return None


def long_of_wide(df: DataFrame, key: str, models: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """A wide table of metric columns as (id, model, field, metric, suffix, value)."""
    found = {c: p for c in df.columns if (p := parse_metric_column(c, models, metrics))}
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("model", "field", "metric", "suffix"), p)), F.col(c).cast("double").alias("value")) for c, p in found.items()))
    return df.select(F.col(key).alias("id"), F.inline(rows))


def rank_table(df: DataFrame, item: str, source: str, group: str, value: str) -> DataFrame:
    """Mean average-rank of each source per group."""
    from .series import average_rank

    return df.withColumn("_r", average_rank(value, [group, item])).groupBy(group, source).agg(F.avg("_r").alias("mean_rank"))


def label_audit(df: DataFrame, labels: str, canonical: Column, rubric: list[str]) -> DataFrame:
    """Counts of (raw, canonical) labels and whether the rubric has them; ``canonical`` is over a column ``raw``."""
    return df.select(F.explode(labels).alias("raw")).withColumn("canonical", canonical).groupBy("raw", "canonical").agg(F.count(F.lit(1)).alias("n")).withColumn("in_rubric", F.col("canonical").isin(rubric))


def stage_counts(df: DataFrame, stage: str, target: str) -> DataFrame:
    """Rows per target and stage, and the running start of each stage's training rows."""
    counts = df.groupBy(stage).agg(*(F.count_if(F.col(target) == t).alias(t) for t in ("treino", "validacao", "teste")), F.count_if(F.col(target).isNull()).alias("ignorados"))
    before = F.sum("treino").over(Window.orderBy(stage).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("inicio", F.coalesce(before, F.lit(0)))


def cost_efficiency(results: DataFrame, cost: DataFrame) -> DataFrame:
    """Mean score per field, metric, suffix and model beside the model's training tokens; best and worst are marked."""
    mean = results.groupBy("field", "metric", "suffix", "model").agg(F.avg("value").alias("score"))
    w = Window.partitionBy("field", "metric", "suffix")
    joined = mean.join(cost.select("model", "tokens"), "model", "left")
    return joined.withColumn("best", F.col("score") == F.max("score").over(w)).withColumn("worst", F.col("score") == F.min("score").over(w)).withColumn("per_mtoken", F.try_divide("score", F.col("tokens") / 1e6))


def annotation_tasks(df: DataFrame, doc: str, model: str, text: str, n_models: int, seed: int = 42) -> DataFrame:
    """Blind tasks: a document's answers in hash order as columns texto_1.., tasks shuffled by hash."""
    order = F.md5(F.concat_ws("|", F.col(doc).cast("string"), model, F.lit(str(seed))))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(order, model))
    wide = df.withColumn("_p", place).groupBy(doc).pivot("_p", list(range(1, n_models + 1))).agg(F.first(text))
    named = wide.select(doc, *(F.col(str(k)).alias(f"texto_{k}") for k in range(1, n_models + 1)))
    return named.withColumn("ordem", F.md5(F.concat_ws("|", F.col(doc).cast("string"), F.lit(str(seed)))))


def accumulate(rounds: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of retry rounds added up."""
    return rounds.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters), F.count(F.lit(1)).alias("rounds"))


def resource_summary(df: DataFrame, by: list[str], series: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(f(c).alias(f"{name}_{c}") for c in series for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def data_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, without reading more than footers and counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def validate_container(main: DataFrame, sides: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Ids of side tables that the main table does not have."""
    out = None
    for name, df in sides.items():
        own = df.select(key).distinct().join(main.select(key), key, "left_anti").select(F.lit(name).alias("table"), key)
        out = own if out is None else out.unionByName(own)
    return out
