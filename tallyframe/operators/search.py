"""TF-IDF search and matching of embedding units, as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_accents


def terms_of(df: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(key, term, tf) of words of two letters or more and their bigrams, accents folded."""
    words = F.filter(F.split(F.lower(fold_accents(text)), r"[^\w]+"), lambda w: F.length(w) > 1)
    own = df.select(key, words.alias("_w"))
    pairs = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.try_element_at("_w", i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = F.concat("_w", pairs) if bigrams else F.col("_w")
    return own.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(terms: DataFrame, key: str, n_docs: int, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(weights key, term, w; idf term, idf): sublinear tf, smoothed idf, unit length."""
    df_ = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= max_df * n_docs)
    idf = df_.select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = terms.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("_n")).alias("w")), idf


def top_k(queries: DataFrame, query_key: str, docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """The k documents of the highest positive cosine of each query, ties by key."""
    n = docs.count()
    weights, idf = tfidf(terms_of(docs, key, text), key, n)
    q = terms_of(queries, query_key, text).join(idf, "term").select(query_key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("q"))
    norm = q.groupBy(query_key).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("_n"))
    q = q.join(norm, query_key).select(query_key, "term", (F.col("q") / F.col("_n")).alias("q"))
    scores = q.join(weights, "term").groupBy(query_key, key).agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key))
    return scores.withColumn("place", place).filter(F.col("place") <= k)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_scores(candidate: DataFrame, reference: DataFrame, pair: str, vector: str) -> DataFrame:
    """P, R and F1 per pair: mean best cosine of candidate units, of reference units, harmonic mean.

    candidate and reference: (pair, unit, vector) with vectors of length 1; units meet within their pair only.
    """
    both = candidate.select(pair, F.col("unit").alias("_c"), F.col(vector).alias("_cv")).join(reference.select(pair, F.col("unit").alias("_r"), F.col(vector).alias("_rv")), pair)
    cos = both.select(pair, "_c", "_r", dot(F.col("_cv"), F.col("_rv")).alias("_s"))
    best = lambda c, name: cos.groupBy(pair, c).agg(F.max("_s").alias("_m")).groupBy(pair).agg(F.avg("_m").alias(name))
    pr = best("_c", "p").join(best("_r", "r"), pair)
    return pr.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
