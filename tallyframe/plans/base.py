"""Tables and derivations that several queries share, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 4):
    return F.round(c, digits)


MODELS = ("m1", "m2", "m3")


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model, true_json, pred_json, pred_error): gold objects of documents and the answers of three models.

    m2 loses the statistics of every fourth document, m3 has a key too many in every third; every 25th answer of m3 is an error.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    stats = F.struct(F.col("n_chars").alias("n_chars"), (F.col("n_chars") % 7).alias("rest"))
    gold = F.to_json(F.struct("lang", "source", stats.alias("stats")))
    m2 = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct("lang", F.upper("source").alias("source")))).otherwise(gold)
    m3 = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct("lang", "source", stats.alias("stats"), F.lit(1).alias("more")))).otherwise(gold)
    rows = F.inline(F.array(
        F.struct(F.lit("m1").alias("model"), gold.alias("pred_json"), F.lit(None).cast("string").alias("pred_error")),
        F.struct(F.lit("m2").alias("model"), m2.alias("pred_json"), F.lit(None).cast("string").alias("pred_error")),
        F.struct(F.lit("m3").alias("model"), F.when(F.col("doc_id") % 25 != 0, m3).alias("pred_json"), F.when(F.col("doc_id") % 25 == 0, F.lit("timeout")).alias("pred_error")),
    ))
    return d.select(F.col("doc_id").cast("string").alias("id"), gold.alias("true_json"), rows)


#: Path lists of the same derivation.
PATHS_SQL = """
paths AS (
  SELECT d.doc_id, m.model,
    ['lang', 'source', 'stats', 'stats.n_chars', 'stats.rest'] AS t,
    CASE WHEN m.model = 'm3' AND doc_id % 25 = 0 THEN ['erro']
      WHEN m.model = 'm2' AND doc_id % 4 = 0 THEN ['lang', 'source']
      WHEN m.model = 'm3' AND doc_id % 3 = 0 THEN ['lang', 'source', 'stats', 'stats.n_chars', 'stats.rest', 'more']
      ELSE ['lang', 'source', 'stats', 'stats.n_chars', 'stats.rest'] END AS pp
  FROM documents d, (VALUES ('m1'), ('m2'), ('m3')) m(model)),
shape AS (
  SELECT doc_id, model, len(list_intersect(t, pp)) AS c, len(t) AS nt, len(pp) AS np, t, pp FROM paths),
scored AS (
  SELECT doc_id, model, t, pp, round(c / np, 3) AS P, round(c / nt, 3) AS R,
    round(CASE WHEN c = 0 THEN 0 ELSE 2 * (c / np) * (c / nt) / (c / np + c / nt) END, 3) AS F1 FROM shape)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, protocol, value): mean discount per supplier and line number."""
    li = table(spark, sf_dir, "lineitem")
    units = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))  # whole units, so that sums are exact
    return li.groupBy(F.col("l_suppkey").cast("string").alias("doc"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("protocol")).agg((units.cast("double") / (100 * F.count(F.lit(1)))).alias("value"))


SCORES_SQL = """
scores AS (SELECT l_suppkey::VARCHAR AS doc, 'p' || l_linenumber AS protocol, sum(round(l_discount * 100)::BIGINT)::DOUBLE / (100 * count(*)) AS value FROM lineitem GROUP BY 1, 2),
whole AS (SELECT * FROM scores WHERE doc IN (SELECT doc FROM scores GROUP BY doc HAVING count(DISTINCT protocol) = (SELECT count(DISTINCT protocol) FROM scores))),
ranked AS (SELECT *, rank() OVER (PARTITION BY doc ORDER BY value DESC) + (count(*) OVER (PARTITION BY doc, value) - 1) / 2 AS rank FROM whole)
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, source, rater, note 1 to 4): notes of three raters on suppliers' lines."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    note = (F.sum("l_quantity") % 4 + 1).cast("int")
    return li.groupBy(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("rater")).agg(note.alias("note"))


NOTES_SQL = """
notes AS (SELECT l_suppkey AS doc, l_returnflag AS source, l_linenumber AS rater, (sum(l_quantity) % 4 + 1)::INT AS note FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2, 3)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, epoch, loss, eval_loss, tokens, seconds): the events of a user as a training log."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("event_id") / 500).alias("epoch"), F.col("value").alias("loss"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"), (F.col("event_id") * 10 + F.col("user_id")).alias("tokens"), (F.col("event_id") % 1000 + 1).alias("seconds"),
    )


LOG_SQL = """
log AS (SELECT user_id AS run, event_id AS step, event_id / 500 AS epoch, value AS loss, CASE WHEN event_type = 'purchase' THEN value END AS eval_loss,
  event_id * 10 + user_id AS tokens, event_id % 1000 + 1 AS seconds FROM events)
"""
