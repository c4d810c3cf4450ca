"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``.  The models of
the first two stages are fitted on the labelled rows of ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import jaccard, langid, line_dedup, packing, quality_net
from tallyframe.llm.bpe import default_path
from tallyframe.llm.common import Scratch, crc_mod, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language stays under one half."""
    model = langid.train(docs.filter(crc_mod("doc_id", 4) != 2), "doc_id", "text", "lang")
    return langid.keep_identified(docs, model)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a quality score under one half."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return quality_net.keep_good(docs, quality_net.train(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no word is left with them."""
    cut = line_dedup.drop_repeated_lines(docs)
    left = (F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def join_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return jaccard.keep_representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("lines", drop_lines),
    ("near-duplicates", join_shingles),
    ("packing", pack),
]

#: Models and token packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
