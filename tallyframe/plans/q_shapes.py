"""Queries over chart frames, small filters and lookups, dates, and the validation of judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import judges, messages, shapes
from .base import LOG_SQL, NOTES_SQL, log, notes, r, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


RATERS, SCALE = [1, 2, 3], [1, 2, 3, 4]
QUARTERS = "quantile_cont({0}, 0.25) AS q1, median({0}) AS median, quantile_cont({0}, 0.75) AS q3"
#: Documents with the notes of all three raters side by side.
MATRIX_SQL = f"""
{NOTES_SQL.strip()},
mx AS (SELECT doc, source, max(note) FILTER (rater = 1) AS r1, max(note) FILTER (rater = 2) AS r2, max(note) FILTER (rater = 3) AS r3 FROM notes GROUP BY 1, 2 HAVING count(DISTINCT rater) = 3)
"""


@query(
    "SELECT 'o_totalprice' AS \"column\", count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice)::DOUBLE AS min, "
    f"{QUARTERS.format('o_totalprice')}, max(o_totalprice)::DOUBLE AS max FROM orders "
    "UNION ALL SELECT 'o_custkey', count(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), min(o_custkey), quantile_cont(o_custkey, 0.25), median(o_custkey), quantile_cont(o_custkey, 0.75), max(o_custkey) FROM orders"
)
def shape_describe(s, d):
    return shapes.describe(table(s, d, "orders"), ["o_totalprice", "o_custkey"]).withColumns({c: r(c) for c in ("mean", "sd")})


@query(
    f"WITH q AS (SELECT l_returnflag, l_linenumber, count(l_extendedprice) AS n, {QUARTERS.format('l_extendedprice')} FROM lineitem GROUP BY 1, 2), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
    "SELECT l_returnflag, l_linenumber, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN lo AND hi) AS whisker_low, "
    "max(l_extendedprice) FILTER (l_extendedprice BETWEEN lo AND hi) AS whisker_high, count(*) FILTER (l_extendedprice NOT BETWEEN lo AND hi) AS outliers FROM lineitem JOIN f USING (l_returnflag, l_linenumber) GROUP BY 1, 2"
)
def shape_boxes(s, d):
    return shapes.box_statistics(table(s, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice")


@query("SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS \"O\", nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY 1")
def shape_heatmap(s, d):
    return shapes.heatmap(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query(f"WITH {LOG_SQL} SELECT 'tokens' AS type, run, count(tokens) AS n, sum(tokens)::DOUBLE AS sum, round(avg(tokens), 4) AS mean FROM log GROUP BY run UNION ALL SELECT 'seconds', run, count(seconds), sum(seconds)::DOUBLE, round(avg(seconds), 4) FROM log GROUP BY run")
def shape_bars_by_type(s, d):
    return shapes.bars_by_type(log(s, d), "run", ["tokens", "seconds"]).withColumn("mean", r("mean"))


@query(f"WITH {LOG_SQL} SELECT coalesce(t.run, e.run) AS run, coalesce(t.step, e.step) AS step, t.loss, e.eval_loss FROM (SELECT run, step, loss FROM log WHERE eval_loss IS NULL OR step % 2 = 0) t FULL JOIN (SELECT run, step, eval_loss FROM log WHERE eval_loss IS NOT NULL) e ON e.run = t.run AND e.step = t.step")
def shape_loss_table(s, d):
    own = log(s, d)
    return shapes.loss_table(own.filter("eval_loss is null or step % 2 = 0").select("run", "step", "loss"), own.filter("eval_loss is not null").select("run", "step", "eval_loss"), ["run", "step"])


@query(f"WITH {LOG_SQL} SELECT run, step, (sum(tokens) OVER w)::BIGINT AS sum_tokens, count(*) OVER w AS sum_instances FROM log WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)")
def shape_token_evolution(s, d):
    return shapes.token_evolution(log(s, d), ["run"], "step", "tokens").select("run", "step", "sum_tokens", "sum_instances")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def shape_limit_items(s, d):
    return shapes.limit_items(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50)


@query("SELECT c_custkey, c_nationkey FROM customer")
def shape_sort_split(s, d):
    return shapes.sort_split(shapes.sort_results(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), "c_nationkey", "c_custkey")


@query("SELECT d.doc_id, d.lang, l.quality / 1000 AS quality, l.toxic / 1000 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_pair_extraction(s, d):
    return shapes.pair_extraction_join(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id", ["quality", "toxic"])


@query(
    "WITH w AS (SELECT 'f ' || c_custkey AS key, NULL AS date, NULL AS kind FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_custkey::VARCHAR, '1997' || lpad((c_nationkey % 12 + 1)::VARCHAR, 2, '0'), NULL FROM customer WHERE c_nationkey > 20 "
    "UNION ALL SELECT 'O ' || c_custkey, '1996' || lpad((c_nationkey % 12 + 1)::VARCHAR, 2, '0'), '1-urgent' FROM customer), "
    "o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS rec, o_orderstatus || ' ' || o_custkey AS proc, strftime(o_orderdate, '%Y%m') AS month, o_orderpriority FROM orders) "
    "SELECT DISTINCT o_orderkey FROM o JOIN w ON upper(w.key) IN (rec, proc) AND (w.date IS NULL OR w.date = month) AND (w.kind IS NULL OR upper(w.kind) = o_orderpriority)"
)
def filter_process(s, d):
    c = table(s, d, "customer")
    month, k, none = F.lpad((F.col("c_nationkey") % 12 + 1).cast("string"), 2, "0"), F.col("c_custkey").cast("string"), F.lit(None).cast("string")
    wanted = c.filter("c_nationkey = 1").select(F.concat(F.lit("f "), k).alias("key"), none.alias("date"), none.alias("kind"))
    wanted = wanted.unionByName(c.filter("c_nationkey > 20").select(k.alias("key"), F.concat(F.lit("1997"), month).alias("date"), none.alias("kind")))
    wanted = wanted.unionByName(c.select(F.concat(F.lit("O "), k).alias("key"), F.concat(F.lit("1996"), month).alias("date"), F.lit("1-urgent").alias("kind")))
    o = table(s, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderstatus", F.col("o_custkey").cast("string")).alias("process"), F.lit("").alias("klass"), F.date_format("o_orderdate", "yyyyMM").alias("month"), "o_orderpriority")
    return shapes.process_filter(o, wanted, "o_orderkey", "process", "klass", "month", "o_orderpriority").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_suppkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4))")
def filter_document(s, d):
    wanted = table(s, d, "customer").filter("c_nationkey = 4").select(F.col("c_custkey").alias("seq"))
    records = table(s, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("seq"))
    return shapes.document_filter(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("seq")), wanted, "seq", "o_orderkey", records).select("o_orderkey")


@query("SELECT p_partkey, p_size, p_name FROM part WHERE p_size BETWEEN 1 AND 10 AND p_brand = 'Brand#2' AND trim(p_name) <> ''")
def filter_folds(s, d):
    return shapes.fold_filter(table(s, d, "part"), "p_size", "p_name", {"p_brand": "Brand#2"}, ["p_partkey", "p_size", "p_name"])


@query("SELECT p_partkey FROM part WHERE length(p_name) > 10")
def filter_long_answers(s, d):
    return shapes.long_answers(table(s, d, "part"), "p_name").select("p_partkey")


@query("SELECT doc_id FROM documents WHERE strlen(text) >= 10 AND doc_id % 3 <> 0")
def filter_already_exported(s, d):
    whole = F.to_json(F.struct("doc_id", "lang"))
    docs = table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.expr("left(to_json(struct(doc_id, lang)), length(to_json(struct(doc_id, lang))) - 1)")).otherwise(whole).alias("json"))
    return shapes.already_exported(docs, "text", "json", parse=True).select("doc_id")


@query("SELECT doc_id, n_chars, (ceil((n_chars + 256) / 256) * 256)::BIGINT AS padded FROM documents WHERE n_chars <= 900")
def messages_length_filter(s, d):
    return messages.length_filter(table(s, d, "documents"), F.col("n_chars"), 900).select("doc_id", "n_chars", messages.round_length(F.col("n_chars")).alias("padded"))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS total, round(avg(length(text)), 4) AS mean, min(length(text)) AS min, max(length(text)) AS max, sum(greatest(0, length(text) - 40))::BIGINT AS doc_tokens FROM documents GROUP BY lang")
def messages_token_stats(s, d):
    return messages.token_stats(table(s, d, "documents"), ["lang"], "text", 40, F.length).withColumn("mean", r("mean"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%d') || ' de ' || ['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'][month(o_orderdate)] || ' de ' || strftime(o_orderdate, '%Y') AS long_date, "
    "strftime(o_orderdate::DATE + 45, '%Y%m%d') AS due, strftime(o_orderdate, '%Y%m%d') AS parsed, o_orderdate::DATE < DATE '1997-03-01' AS early FROM orders"
)
def dates_written(s, d):
    o = table(s, d, "orders").withColumn("written", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", dates.long_date("o_orderdate").alias("long_date"), F.date_format(dates.add_days("o_orderdate", 45), "yyyyMMdd").alias("due"), F.date_format(dates.parse_datetime("written"), "yyyyMMdd").alias("parsed"), dates.compare_dates("written", "<", F.lit("1997-03-01")).alias("early"))


@query("SELECT doc_id, replace(text, chr(10), ' ') AS short FROM (SELECT doc_id, regexp_replace(text, '[\\r\\n]+', chr(10), 'g') AS text FROM documents)")
def text_short_value(s, d):
    return table(s, d, "documents").select("doc_id", text.short_value("text").alias("short"))


@query(f"WITH {NOTES_SQL} SELECT unnest(range(least(2, min(note)), greatest(6, max(note)) + 1))::INT AS category FROM notes")
def judge_scale(s, d):
    return judges.scale_categories(notes(s, d), "note", (2, 6))


#: Raters 1 and 2 are the people, rater 3 is the judge.
GROUPED_SQL = f"{NOTES_SQL.strip()}, wide AS (SELECT doc, source, median(note) FILTER (rater < 3) AS people, median(note) FILTER (rater = 3) AS judge FROM notes GROUP BY 1, 2 HAVING people IS NOT NULL AND judge IS NOT NULL)"


def _wide(s, d):
    own = notes(s, d).withColumn("group", F.when(F.col("rater") < 3, "people").otherwise("judge"))
    return judges.long_by_group(own, ["doc", "source"], "group", ["people", "judge"], "note")


@query(f"WITH {GROUPED_SQL} SELECT doc, source, people, judge FROM wide")
def judge_long_by_group(s, d):
    return _wide(s, d)


@query(
    f"WITH {MATRIX_SQL.strip()}, l AS (SELECT unnest([r1, r2, r3]) AS v FROM mx), "
    "o AS (SELECT count(*) AS n_items, 1 - avg(((r1 - r2) ** 2 + (r1 - r3) ** 2 + (r2 - r3) ** 2) / 3) / 9 AS po, avg((r1 = r2 AND r2 = r3)::INT) AS exact, avg((greatest(r1, r2, r3) - least(r1, r2, r3) <= 1)::INT) AS within_1 FROM mx), "
    "e AS (SELECT 1 - 2 * var_pop(v) / 9 AS pe FROM l), k AS (SELECT *, (po - pe) / (1 - pe) AS kappa FROM o, e) "
    "SELECT n_items, round(po, 4) AS p_o, round(pe, 4) AS p_e, round(kappa, 4) AS kappa, round(exact, 4) AS exact, round(within_1, 4) AS within_1, "
    "CASE WHEN kappa < 0.21 THEN 'nenhuma' WHEN kappa < 0.4 THEN 'mínima' WHEN kappa < 0.6 THEN 'fraca' WHEN kappa < 0.8 THEN 'moderada' WHEN kappa < 0.9 THEN 'forte' ELSE 'quase perfeita' END AS band, kappa >= 0.6 AS approved FROM k"
)
def judge_internal_agreement(s, d):
    found = judges.internal_agreement(notes(s, d), ["doc", "source"], "rater", RATERS, "note", SCALE)
    return found.withColumns({c: r(c) for c in ("p_o", "p_e", "kappa", "exact", "within_1")})


@query(
    f"WITH {MATRIX_SQL.strip()}, p AS (SELECT '1' AS a, '2' AS b, r1 AS x, r2 AS y FROM mx UNION ALL SELECT '1', '3', r1, r3 FROM mx UNION ALL SELECT '2', '3', r2, r3 FROM mx), "
    "m AS (SELECT a, b, count(*) AS n, 1 - avg((x - y) ** 2) / 9 AS po, 1 - (avg(x * x) + avg(y * y) - 2 * avg(x) * avg(y)) / 9 AS pe, avg((x = y)::INT) AS exact FROM p GROUP BY 1, 2) SELECT a, b, n, round((po - pe) / (1 - pe), 4) AS kappa, round(exact, 4) AS exact FROM m"
)
def judge_pair_agreement(s, d):
    found = judges.pair_agreement(notes(s, d), ["doc", "source"], "rater", RATERS, "note", SCALE)
    return found.withColumns({c: r(c) for c in ("kappa", "exact")})


@query(
    f"WITH {MATRIX_SQL.strip()}, l AS (SELECT doc, source, unnest([1, 2, 3])::VARCHAR AS rater, unnest([r1, r2, r3]) AS v FROM mx), "
    "k AS (SELECT *, rank() OVER (PARTITION BY doc, source ORDER BY v DESC) + (count(*) OVER (PARTITION BY doc, source, v) - 1) / 2 AS rk FROM l), "
    "g AS (SELECT rater, count(*) AS n, avg(v) AS mean, sum(rk) AS s, sum(rk * rk) AS q FROM k GROUP BY 1), t AS (SELECT any_value(n) AS n, (sum(s * s) - sum(s) ** 2 / 3) / any_value(n) AS between_, (sum(q) - any_value(n) * 12) / (any_value(n) * 2) AS within_ FROM g) "
    "SELECT rater, round(g.mean, 4) AS mean, round(s / g.n, 4) AS mean_rank, g.n, round(between_ / within_, 4) AS chi2, 2 AS degrees, round(exp(-between_ / within_ / 2), 6) AS p FROM g, t"
)
def judge_internal_severity(s, d):
    found = judges.internal_severity(notes(s, d), ["doc", "source"], "rater", RATERS, "note")
    return found.withColumns({"mean": r("mean"), "mean_rank": r("mean_rank"), "chi2": r("chi2"), "p": r("p", 6)})


@query(
    f"WITH {GROUPED_SQL}, m AS (SELECT count(*) AS n, 1 - avg((judge - people) ** 2) / 9 AS po, 1 - (avg(judge * judge) + avg(people * people) - 2 * avg(judge) * avg(people)) / 9 AS pe, avg(judge - people) AS bias, "
    "count(*) FILTER (judge >= 3 AND people < 3) AS only_judge, count(*) FILTER (judge < 3 AND people >= 3) AS only_reference FROM wide) SELECT 'judge' AS judge, n, round((po - pe) / (1 - pe), 4) AS kappa, round(bias, 4) AS bias, only_judge, only_reference FROM m"
)
def judge_measures(s, d):
    return judges.judge_measures(_wide(s, d), "people", ["judge"], SCALE).withColumns({c: r(c) for c in ("kappa", "bias")})


@query(None)
def judge_validation(s, d):
    return judges.validate_judges(_wide(s, d), ["doc", "source"], "people", ["judge"], SCALE)


@query(None)
def judge_source_contrasts(s, d):
    return judges.source_contrasts(notes(s, d), "doc", "source", ["A", "N", "R"], "note")
