"""Keyed outputs that can be resumed: pending rows, upserts, retries, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import failed, successful

SCHEMA = "chave string, resumo string, resposta string, erro string"


def pending(items: DataFrame, output: DataFrame, key: str = "chave") -> DataFrame:
    """Items without a successful row in the output."""
    done = successful(output).select(F.trim(F.col(key).cast("string")).alias("_k")).distinct()
    return items.join(done, F.trim(F.col(key).cast("string")) == F.col("_k"), "left_anti")


def last_wins(existing: DataFrame, new: DataFrame, key: str = "chave") -> DataFrame:
    """New rows replace those of their key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_parquet(spark: SparkSession, path: str, new: DataFrame, key: str = "chave") -> None:
    """Last write wins; the new table is written beside the old one and renamed, the old one stays as .bak."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda suffix: jvm.org.apache.hadoop.fs.Path(path + suffix)
    fs = place("").getFileSystem(conf)
    there = fs.exists(place(""))
    merged = last_wins(spark.read.parquet(path), new, key) if there else new
    fs.delete(place(".new"), True)
    merged.write.parquet(path + ".new")
    if there:
        fs.delete(place(".bak"), True)
        fs.rename(place(""), place(".bak"))
    fs.rename(place(".new"), place(""))


def run_batches(items: DataFrame, output: DataFrame, infer: Callable[[DataFrame], DataFrame], rounds: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Infers pending items, then again what failed, up to ``rounds`` more times; ``keep`` writes and rereads a state."""
    state = output
    for turn in range(rounds + 1):
        todo = pending(items, state)
        if turn:
            todo = todo.join(failed(state).select("chave"), "chave", "left_semi")
        if todo.isEmpty():
            break
        state = keep(last_wins(state, infer(todo)))
    return state


def batch_summary(output: DataFrame) -> DataFrame:
    """Rows, errors, tokens and seconds from the summaries (JSON text)."""
    s = F.try_parse_json("resumo")
    number = lambda path, kind: F.try_variant_get(s, path, kind)
    bad = F.coalesce(F.trim("erro"), F.lit("")) != ""
    return output.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("errors"), F.sum(number("$.prompt_tokens", "bigint")).alias("prompt_tokens"),
        F.sum(number("$.completion_tokens", "bigint")).alias("completion_tokens"), F.sum(number("$.tempo", "double")).alias("seconds"),
    )


def token_cost(output: DataFrame, in_price: float = 5, out_price: float = 20, context: int = 32768) -> DataFrame:
    """Token sums, their price per million, and the number of rows over a context size."""
    s = F.try_parse_json("resumo")
    a, b = (F.coalesce(F.try_variant_get(s, f"$.{k}_tokens", "bigint"), F.lit(0)) for k in ("prompt", "completion"))
    return output.agg(F.sum(a).alias("input"), F.sum(b).alias("output"), F.round((F.sum(a) * in_price + F.sum(b) * out_price) / 1e6, 6).alias("cost"), F.count_if(a + b > context).alias("over_context"))


def refresh(rule: bool | int | None, oldest_minutes: float) -> bool:
    """None and False: never; True: always; a number of minutes: when the oldest map is older."""
    return rule if isinstance(rule, bool) else rule is not None and oldest_minutes > rule


def process_answer(answer, kind: str):
    """Struct (resposta, erro): text must not be blank; JSON is checked and written again in one form."""
    x = F.col(answer)
    blank = F.coalesce(F.trim(x), F.lit("")) == ""
    if kind == "str":
        return F.struct(F.when(~blank, x).alias("resposta"), F.when(blank, F.lit("empty answer")).alias("erro"))
    body = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    v = F.try_parse_json(body)
    return F.struct(F.to_json(v).alias("resposta"), F.when(blank, F.lit("empty answer")).when(v.isNull(), F.lit("invalid JSON")).alias("erro"))


def extractions_of(df: DataFrame, model: str) -> DataFrame:
    """Rows (id, resposta) -> one extractions table: empty and broken answers become errors, free text an object."""
    x = F.col("resposta")
    blank, v = F.coalesce(F.trim(x), F.lit("")) == "", F.try_parse_json("resposta")
    looks = F.trim(x).startswith("{")
    return df.select(
        F.trim(F.col("id").cast("string")).alias("id"), F.lit(model).alias("model"),
        F.when(~blank & v.isNotNull() & looks, x).when(~blank & ~looks, F.to_json(F.struct(x.alias("resposta")))).alias("json"),
        F.when(blank, F.lit("resposta vazia")).when(looks & v.isNull(), F.lit("JSON inválido")).alias("error"),
    )
