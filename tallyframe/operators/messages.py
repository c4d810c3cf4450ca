"""Training messages, prompts and token statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, token_estimate, word_count


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(inputs: DataFrame, outputs: DataFrame, target: str | None = None, split: DataFrame | None = None) -> DataFrame:
    """(id, messages) of pairs with text on both sides, of one target of the split if given."""
    both = inputs.select("id", F.col("text").alias("_in")).join(outputs.select("id", F.col("text").alias("_out")), "id").filter(~is_blank("_in") & ~is_blank("_out"))
    if split is not None:
        both = both.join(split.filter(F.col("alvo") == target).select("id"), "id", "left_semi")
    return both.select("id", F.array(message("user", F.col("_in")), message("assistant", F.col("_out"))).alias("messages"))


def build_messages_all(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every input; an assistant message only where there is a gold answer."""
    both = inputs.select("id", F.col("text").alias("_in")).join(outputs.select("id", F.col("text").alias("_out")), "id", "left")
    user = F.array(message("user", F.col("_in")))
    return both.select("id", F.when(is_blank("_out"), user).otherwise(F.concat(user, F.array(message("assistant", F.col("_out"))))).alias("messages"))


def chat_text(messages: str, template: str = "<|{role}|>\n{content}\n") -> Column:
    """Messages as one text by a template."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{content}")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(head), m["role"], F.lit(middle), m["content"], F.lit(tail))), "")


def word_stats(df: DataFrame, by: list[str], text: str) -> DataFrame:
    n = word_count(text)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.stddev_samp(n).alias("sd"), F.sum(n).alias("sum"))


def token_stats(df: DataFrame, by: list[str], text: str, template_tokens: int = 0, count: Callable[[str], Column] = token_estimate) -> DataFrame:
    n = count(text)
    doc = F.greatest(F.lit(0), n - template_tokens)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.avg(n).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.sum(doc).alias("doc_tokens"))


def length_filter(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    return df.filter(tokens <= most)


def context_estimate(df: DataFrame, tokens: str, margin: float = 1.1, multiple: int = 128) -> DataFrame:
    """The largest count with a margin, rounded up."""
    return df.agg((F.ceil(F.max(tokens) * margin / multiple) * multiple).cast("bigint").alias("context"))


def round_length(tokens: Column, margin: int = 256) -> Column:
    return (F.ceil((tokens + margin) / 256) * 256).cast("bigint")


def mask_labels(ids: str, start: str, mask: str) -> Column:
    """-100 before the answer's start and on padding."""
    return F.transform(ids, lambda x, i: F.when((i < F.col(start)) | (F.element_at(mask, i + 1) == 0), -100).otherwise(x))


def dataset_format(columns: list[str]) -> str:
    if "messages" in columns:
        return "messages"
    if {"prompt", "completion"} <= set(columns):
        return "prompt_completion"
    raise ValueError("neither messages nor prompt and completion")


def assemble_document(sentences: DataFrame, key: str, section: str, line: str, text: str) -> DataFrame:
    """Sentences of a document in line order, joined per section and in whole."""
    ordered = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), " ")
    parts = sentences.groupBy(key, section).agg(ordered(F.struct(F.col(line).alias("l"), F.col(text).alias("t"))).alias("_text"), F.min(line).alias("_first"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_first").alias("l"), F.col("_text").alias("t"), F.col(section).alias("s")))), lambda x: F.concat(F.upper(x["s"]), F.lit(": "), x["t"])), "\n")
    return parts.groupBy(key).agg(body.alias("article"))


def valid_json_rate(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Outputs that parse as JSON and those that do not; blank ones do not."""
    ok = ~is_blank(text) & F.try_parse_json(text).isNotNull()
    return df.groupBy(*by).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def prediction_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Smallest, largest and the lower quartile as the value at place n div 4 of the sorted values."""
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.element_at(F.array_sort(F.collect_list(value)), F.floor(F.count(value) / 4).cast("int") + 1).alias("q1"))
