"""Comparing extractions: gold JSON against the answers of any number of models, as a long table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, similarity

GLOBAL, STRUCTURE = "(global)", "(estrutura)"
#: Order of the metrics of one field.
METRICS = ("bertscore", "rouge", "rouge1", "rouge2", "levenshtein", "sbert", "sbert_pequeno", "sbert_medio", "sbert_grande")
ALIASES = {"rouge_1": "rouge1", "rouge_2": "rouge2", "rouge_l": "rouge", "rougeL": "rouge"}
SCHEMA = "id string, model string, field string, metric string, suffix string, value double"


@dataclass
class MetricPlan:
    """Metric -> fields.  Without entries the whole text gets ROUGE-L and the structure the ROUGE-1 label."""

    fields: dict[str, list[str]] = field(default_factory=dict)
    virtual: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        own = {ALIASES.get(m, m): list(dict.fromkeys(f)) for m, f in self.fields.items()}
        unknown = set(own) - set(METRICS)
        if unknown:
            raise ValueError(f"unknown metrics: {sorted(unknown)}")
        for name, metric in ((GLOBAL, "rouge"), (STRUCTURE, "rouge1")):
            if not any(name in f for f in own.values()):
                own.setdefault(metric, []).append(name)
        self.fields = own

    def metrics_of(self, name: str) -> list[str]:
        return [m for m in METRICS if name in self.fields.get(m, ())]

    def ordered_fields(self) -> list[str]:
        """Fields by first appearance; ROUGE-2's list is read before ROUGE-1's."""
        order = sorted(self.fields, key=lambda m: METRICS.index({"rouge1": "rouge2", "rouge2": "rouge1"}.get(m, m)))
        return list(dict.fromkeys(f for m in order for f in self.fields[m] if not f.startswith("(")))


def plan_of_yaml(config: dict, quick: bool = False) -> MetricPlan:
    """Keys such as rouge_l or rouge_2 with lists of fields; a quick test scores neural fields with ROUGE-L."""
    fields: dict[str, list[str]] = {}
    for key, names in config.items():
        metric = ALIASES.get(key, key)
        if quick and metric.startswith(("bertscore", "sbert")):
            metric = "rouge"
        if metric in METRICS and names:
            fields.setdefault(metric, []).extend([names] if isinstance(names, str) else names)
    return MetricPlan(fields)


Encoder = Callable[[list[str]], "object"]


def score_texts(true: str, pred: str, metric: str, encode: Encoder = similarity.hashed_vectors) -> dict[str, float]:
    """Scores of two texts; two blank texts are equal, one blank text scores 0."""
    suffixes = ("SIM",) if metric == "levenshtein" else ("P", "R", "F1")
    blank = (not true.strip(), not pred.strip())
    if any(blank):
        return dict.fromkeys(suffixes, float(all(blank)))
    if metric == "levenshtein":
        return {"SIM": round(similarity.indel_ratio(true, pred), 3)}
    if metric.startswith("rouge"):
        values = similarity.rouge(true, pred, metric)
    else:
        units = (lambda t: t.split()) if metric == "bertscore" else split_sentences
        values = similarity.unit_match(encode(units(pred)), encode(units(true)))
    digits = 4 if metric.startswith("sbert") else 3
    return {s: round(v, digits) for s, v in zip(suffixes, values)}


def split_sentences(text: str) -> list[str]:
    import re

    return [x for part in re.split(r"(?<=[.!?;:])\s+|\n+", text) if (x := part.strip())]


def compare_values(true, pred, plan: MetricPlan, encode: Encoder = similarity.hashed_vectors) -> list[tuple[str, str, str, float]]:
    """(field, metric, suffix, value) of one gold and one predicted object; a gold error gives nothing."""
    if isinstance(true, dict) and "erro" in true:
        return []
    for name, sources in plan.virtual.items():
        for side in (true, pred):
            if isinstance(side, dict) and "erro" not in side:
                parts = [x for p in sources if (x := jsontext.path_get(side, p)) is not None]
                side[name] = "\n\n".join(jsontext.markdown({p.split(".")[-1]: x}) for p, x in zip(sources, parts)) or None
    without = lambda d: {k: v for k, v in d.items() if k not in plan.virtual} if isinstance(d, dict) else d
    rows = []
    for metric in plan.metrics_of(GLOBAL):
        t, p = jsontext.pair_text(without(true), without(pred), metric, aligned=False)
        rows += [(GLOBAL, metric, s, v) for s, v in score_texts(t, p, metric, encode).items()]
    true_paths, pred_paths = jsontext.paths(true), jsontext.paths(pred)
    shape = jsontext.structure(without(pred_paths), without(true_paths))
    rows += [(STRUCTURE, m, s, shape[s]) for m in plan.metrics_of(STRUCTURE) for s in ("P", "R", "F1")]
    for name in plan.ordered_fields():
        t, p = true_paths.get(name), pred_paths.get(name)
        empty = (jsontext.is_empty(t), jsontext.is_empty(p))
        for metric in plan.metrics_of(name):
            if any(empty):
                suffixes = ("SIM",) if metric == "levenshtein" else ("P", "R", "F1")
                rows += [(name, metric, s, float(all(empty))) for s in suffixes]
            else:
                rows += [(name, metric, s, v) for s, v in score_texts(*jsontext.pair_text(t, p, metric), metric, encode).items()]
    return rows


def compare(pairs: DataFrame, plan: MetricPlan, encode: Encoder = similarity.hashed_vectors) -> DataFrame:
    """pairs (id, model, true_json, pred_json, pred_error) -> (id, model, field, metric, suffix, value).

    A prediction with an error counts as {"erro": ...}; an unreadable one as {}; a gold text that is
    null or empty gives no rows.
    """

    def parse(text: str | None):
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            return jsontext.json_of_message(text)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, model, true, pred, error in zip(*(c.to_pylist() for c in batch.columns)):
                gold = parse(true)
                if jsontext.is_empty(gold):
                    continue
                guess = {"erro": error} if error else parse(pred)
                for row in compare_values(gold, guess, plan, encode):
                    for c, v in zip(out, (key, model, *row)):
                        c.append(v)
            kinds = [pa.string()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "model", "field", "metric", "suffix", "value"])

    text = lambda c: F.col(c).cast("string")
    return pairs.select(text("id"), text("model"), text("true_json"), text("pred_json"), text("pred_error")).mapInArrow(run, SCHEMA)


def source_vs_models(gold: DataFrame, answers: DataFrame, models: DataFrame) -> DataFrame:
    """Every gold id with every model (a small list, broadcast); absent answers get the error "Inexistente"."""
    grid = gold.select(F.trim(F.col("id").cast("string")).alias("id"), F.col("json").alias("true_json")).crossJoin(F.broadcast(models.select("model").distinct()))
    own = answers.select(F.trim(F.col("id").cast("string")).alias("id"), "model", F.col("json").alias("pred_json"), F.col("error").alias("pred_error"), F.lit(True).alias("_there"))
    return grid.join(own, ["id", "model"], "left").withColumn("pred_error", F.when(F.col("_there").isNull(), F.lit("Inexistente")).otherwise(F.col("pred_error"))).drop("_there")


def global_stats(results: DataFrame) -> DataFrame:
    """Mean, median and sample deviation per model, field, metric and suffix, to 3 decimals."""
    return results.groupBy("model", "field", "metric", "suffix").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.median("value"), 3).alias("median"), F.round(F.stddev_samp("value"), 3).alias("sd")
    )


def wide(results: DataFrame, models: list[str]) -> DataFrame:
    """One row per id and a column per model, field, metric and suffix."""
    named = results.withColumn("_name", F.concat_ws("_", "model", "field", "metric", "suffix"))
    return named.groupBy("id").pivot("_name").agg(F.first("value"))


def compare_models_view(results: DataFrame, models: list[str], field_name: str = GLOBAL, suffix: str = "F1") -> DataFrame:
    """One column per model for one field and suffix, a row per id and technique."""
    return results.filter((F.col("field") == field_name) & (F.col("suffix") == suffix)).groupBy("id", "metric").pivot("model", models).agg(F.first("value"))


def status_counts(pairs: DataFrame) -> DataFrame:
    """Sucesso, Erro and Inexistente per model over all pairs."""
    status = F.when(F.col("pred_error") == "Inexistente", "Inexistente").when(F.col("pred_error").isNotNull(), "Erro").otherwise("Sucesso")
    return pairs.groupBy("model").agg(*(F.count_if(status == s).alias(s) for s in ("Sucesso", "Erro", "Inexistente")))


def structure_columns(pred: str, true: str) -> list:
    """Structural precision, recall and F1 of two columns of path arrays, as native expressions."""
    common = F.size(F.array_intersect(pred, true))
    p = F.coalesce(F.try_divide(common, F.size(pred)), (F.size(true) == 0).cast("double"))
    r = F.coalesce(F.try_divide(common, F.size(true)), (F.size(pred) == 0).cast("double"))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, 3).alias("P"), F.round(r, 3).alias("R"), F.round(f, 3).alias("F1"), F.array_sort(F.array_except(true, pred)).alias("missing"), F.array_sort(F.array_except(pred, true)).alias("extra")]


def examples(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of each field, metric and suffix by id."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("field", "metric", "suffix").orderBy("id", "model"))
    return results.withColumn("place", place).filter(F.col("place") <= n)


def pair_key(a, b):
    """A key that does not depend on the order of two texts, and whether they are swapped."""
    x, y = F.md5(a), F.md5(b)
    return F.concat_ws("_", F.least(x, y), F.greatest(x, y)), x > y


def score_with_cache(pairs: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) -> (a, b, p, r, f1), and the new cache rows (key, p, r, f1).

    Each unordered pair is scored once; P and R change places when a pair comes in reverse.
    """
    key, swapped = pair_key(F.col("a"), F.col("b"))
    keyed = pairs.withColumn("key", key).withColumn("_swapped", swapped)
    ordered = keyed.select("key", F.when(F.col("_swapped"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("_swapped"), F.col("a")).otherwise(F.col("b")).alias("b")).dropDuplicates(["key"])
    fresh = score(ordered.join(cache.select("key"), "key", "left_anti")).select("key", "p", "r", "f1")
    known = cache.select("key", "p", "r", "f1").unionByName(fresh)
    joined = keyed.join(known, "key").select("a", "b", F.when(F.col("_swapped"), F.col("r")).otherwise(F.col("p")).alias("p"), F.when(F.col("_swapped"), F.col("p")).otherwise(F.col("r")).alias("r"), "f1")
    return joined, fresh


def expire_cache(cache: DataFrame, minutes: int, now) -> DataFrame:
    """Cache rows written within the last ``minutes``."""
    return cache.filter(F.col("written_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0)))
