"""Queries over token, judge and observability records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, records
from .base import extractions, log, LOG_SQL, r, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query("SELECT event_id AS id, event_id AS input, event_id * 2 AS output, 0::BIGINT AS reason, 0::BIGINT AS cache, greatest(CASE WHEN event_id % 2 = 0 THEN event_id * 4 ELSE 0 END, event_id * 3) AS total FROM events")
def records_tokens(s, d):
    i = F.col("event_id")
    usage = F.struct(i.alias("prompt_tokens"), (i * 2).alias("completion_tokens"), F.when(i % 2 == 0, i * 4).alias("total_tokens"))
    return records.token_summary(table(s, d, "events").select(i.alias("id"), F.to_json(F.struct(usage.alias("usage"))).alias("json")))


@query("WITH b AS (SELECT event_id AS id, (event_id % 10) / 10 AS p, (event_id % 7) / 7 AS r FROM events), u AS (SELECT id, '(global)' AS field, p, r FROM b UNION ALL SELECT id, 'x', p / 2, r FROM b) SELECT id, field, round(p, 4) AS p, round(r, 4) AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM u")
def records_judge(s, d):
    p, q = (F.col("event_id") % 10) / 10, (F.col("event_id") % 7) / 7
    record = F.struct(p.alias("precision"), q.alias("recall"), F.struct(F.struct((p / 2).alias("precision"), q.alias("recall")).alias("x")).alias("metricas_por_campo"))
    out = records.judge_records(table(s, d, "events").select(F.col("event_id").alias("id"), F.to_json(record).alias("json")))
    return out.select("id", "field", r("p").alias("p"), r("r").alias("r"), r("f1").alias("f1"))


@query("SELECT user_id, event_type AS agent, round(sum(value), 2) AS \"SEG\", max(event_id % 5) AS \"IT\", bool_or(event_id % 11 = 0) AS \"REV\", arg_max(event_id % 2 = 0, event_id) AS \"OK\", count(*) AS \"QTD\" FROM events GROUP BY 1, 2")
def records_observability(s, d):
    i = F.col("event_id")
    steps = table(s, d, "events").select("user_id", F.col("event_type").alias("agent"), i.alias("idx"), F.col("value").alias("seconds"), (i % 5).alias("iteration"), (i % 11 == 0).alias("revised"), (i % 2 == 0).alias("ok"))
    return records.observability_rollup(steps, ["user_id"]).withColumn("SEG", r("SEG", 2))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END AS \"QTD\", length(lang) AS lang_bytes, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 5 END AS keys FROM documents")
def records_fields(s, d):
    e = extractions(s, d).filter("model = 'm2'")
    own = records.field_metrics(e.select("id", "pred_json", F.col("pred_json").alias("json")))
    return own.select("id", "QTD", F.element_at("BYTES", "lang").alias("lang_bytes"), records.count_keys("pred_json").alias("keys"))


@query("SELECT l_returnflag AS grupo, l_linenumber AS source, round(avg(k), 4) AS mean_rank FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY v DESC) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey, v) - 1) / 2 AS k FROM (SELECT l_returnflag, l_suppkey, l_linenumber, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def records_rank_table(s, d):
    own = table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("v"))
    return records.rank_table(own, "l_suppkey", "l_linenumber", "l_returnflag", "v").select(F.col("l_returnflag").alias("grupo"), F.col("l_linenumber").alias("source"), r("mean_rank").alias("mean_rank"))


@query("SELECT raw, regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g') AS canonical, count(*) AS n, raw = 'ECONOMY' AS in_rubric FROM (SELECT unnest([p_type, p_brand]) AS raw FROM part) GROUP BY 1")
def records_label_audit(s, d):
    own = table(s, d, "part").select(F.array("p_type", "p_brand").alias("labels"))
    return records.label_audit(own, "labels", text.canonical_label("raw"), ["economy"])


@query("WITH c AS (SELECT l_linenumber AS stage, count(*) FILTER (l_returnflag = 'A') AS treino, count(*) FILTER (l_returnflag = 'N') AS validacao, count(*) FILTER (l_returnflag = 'R') AS teste, 0::BIGINT AS ignorados FROM lineitem GROUP BY 1) SELECT *, coalesce(sum(treino) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inicio FROM c")
def records_stage_counts(s, d):
    names = F.create_map(*(F.lit(x) for p in (("A", "treino"), ("N", "validacao"), ("R", "teste")) for x in p))
    own = table(s, d, "lineitem").select(F.col("l_linenumber").alias("stage"), F.try_element_at(names, F.col("l_returnflag")).alias("alvo"))
    return records.stage_counts(own, "stage", "alvo")


@query(f"WITH {LOG_SQL} SELECT run, min(loss) AS min_loss, max(loss) AS max_loss, round(avg(loss), 4) AS mean_loss FROM log GROUP BY run")
def records_resources(s, d):
    return records.resource_summary(log(s, d), ["run"], ["loss"]).withColumn("mean_loss", r("mean_loss"))


@query("SELECT user_id, count(*) AS rounds, sum(event_id)::BIGINT AS tokens FROM events GROUP BY 1")
def records_accumulate(s, d):
    return records.accumulate(table(s, d, "events").select("user_id", F.col("event_id").alias("tokens")), ["user_id"], ["tokens"])


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'labels', count(*) FROM labels")
def records_summary(s, d):
    return records.data_summary({"orders": table(s, d, "orders"), "labels": table(s, d, "labels")})


@query("SELECT 'vectors' AS \"table\", vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def records_validate(s, d):
    return records.validate_container(table(s, d, "documents").select(F.col("doc_id").alias("id")), {"vectors": table(s, d, "embeddings").select(F.col("vec_id").alias("id"))})


@query("WITH t AS (SELECT l_orderkey AS doc, l_linenumber::VARCHAR AS m, min(l_partkey)::VARCHAR AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY md5(doc::VARCHAR || '|' || m || '|42'), m) AS k FROM t) SELECT doc, max(v) FILTER (k = 1) AS texto_1, max(v) FILTER (k = 2) AS texto_2, max(v) FILTER (k = 3) AS texto_3, md5(doc::VARCHAR || '|42') AS ordem FROM p GROUP BY doc")
def records_annotation_tasks(s, d):
    own = table(s, d, "lineitem").filter("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("string").alias("m")).agg(F.min("l_partkey").cast("string").alias("v"))
    return records.annotation_tasks(own, "doc", "m", "v", 3)


@query("SELECT doc_id::VARCHAR AS id, m.model, 'total' AS field, 'rouge' AS metric, 'F1' AS suffix, (doc_id % m.k)::DOUBLE AS value FROM documents, (VALUES ('m', 3), ('m_b', 5)) m(model, k)")
def records_long_of_wide(s, d):
    i = F.col("doc_id")
    wide = table(s, d, "documents").select(i.cast("string").alias("id"), (i % 3).alias("m_total_rouge_F1"), (i % 5).alias("m_b_total_rouge_F1"))
    return records.long_of_wide(wide, "id", ["m", "m_b"], compare.METRICS)


@query("WITH m AS (SELECT l_linestatus AS field, l_returnflag AS model, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1, 2) SELECT field, model, score, score = max(score) OVER (PARTITION BY field) AS best, score = min(score) OVER (PARTITION BY field) AS worst FROM m")
def records_cost_efficiency(s, d):
    li = table(s, d, "lineitem").select(F.col("l_linestatus").alias("field"), F.lit("x").alias("metric"), F.lit("F1").alias("suffix"), F.col("l_returnflag").alias("model"), F.col("l_discount").alias("value"))
    cost = li.groupBy("model").agg(F.count(F.lit(1)).alias("tokens"))
    return records.cost_efficiency(li, cost).select("field", "model", r("score", 6).alias("score"), "best", "worst")
