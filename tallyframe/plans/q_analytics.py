"""Queries over comparisons, ordered logs, splits, agreement and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import normal_quantile
from ..operators import agreement, bayes, compare, frequentist, series, splits
from ..streaming import events as streams
from .base import LOG_SQL, MODELS, NOTES_SQL, PATHS_SQL, SCORES_SQL, extractions, log, notes, r, scores, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


STRUCTURE = compare.MetricPlan({"rouge1": [compare.STRUCTURE], "rouge": [compare.GLOBAL]})


def _structure(s, d):
    return compare.compare(extractions(s, d), STRUCTURE).filter(F.col("field") == compare.STRUCTURE)


@query(f"WITH {PATHS_SQL}, long AS (UNPIVOT (SELECT model, P, R, F1 FROM scored) ON P, R, F1 INTO NAME suffix VALUE value) SELECT model, suffix, count(*) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_samp(value), 3) AS sd FROM long GROUP BY 1, 2")
def compare_structure_stats(s, d):
    return compare.global_stats(_structure(s, d)).select("model", "suffix", "n", "mean", "median", "sd")


@query(f"WITH {PATHS_SQL} SELECT doc_id::VARCHAR AS id, model, P, R, F1 FROM scored")
def compare_structure(s, d):
    return _structure(s, d).groupBy("id", "model").pivot("suffix", ["P", "R", "F1"]).agg(F.first("value"))


@query(f"WITH {PATHS_SQL} SELECT doc_id, model, P, R, F1, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(pp, x))), ',') AS missing, array_to_string(list_sort(list_filter(pp, lambda x: NOT list_contains(t, x))), ',') AS extra FROM scored")
def compare_structure_native(s, d):
    base, long = ["lang", "source"], ["lang", "source", "stats", "stats.n_chars", "stats.rest"]
    arr = lambda xs: F.array(*map(F.lit, xs))
    own = table(s, d, "documents").select("doc_id", F.explode(arr(MODELS)).alias("model"), arr(long).alias("t"))
    m, i = F.col("model"), F.col("doc_id")
    p = F.when((m == "m3") & (i % 25 == 0), arr(["erro"])).when((m == "m2") & (i % 4 == 0), arr(base)).when((m == "m3") & (i % 3 == 0), arr([*long, "more"])).otherwise(arr(long))
    return own.withColumn("p", p).select("doc_id", "model", *compare.structure_columns("p", "t")).withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


@query("SELECT m.model, count(*) FILTER (NOT (m.model = 'm3' AND doc_id % 25 = 0) AND NOT (m.model = 'm2' AND doc_id % 9 = 0)) AS \"Sucesso\", count(*) FILTER (m.model = 'm3' AND doc_id % 25 = 0) AS \"Erro\", count(*) FILTER (m.model = 'm2' AND doc_id % 9 = 0) AS \"Inexistente\" FROM documents, (VALUES ('m1'), ('m2'), ('m3')) m(model) GROUP BY 1")
def compare_status(s, d):
    e = extractions(s, d)
    gold = e.filter("model = 'm1'").select("id", F.col("true_json").alias("json"))
    answers = e.filter("NOT (model = 'm2' AND id % 9 = 0)").select("id", "model", F.col("pred_json").alias("json"), F.col("pred_error").alias("error"))
    models = s.createDataFrame([(m,) for m in MODELS], "model string")
    return compare.status_counts(compare.source_vs_models(gold, answers, models))


@query(f"WITH {PATHS_SQL}, l AS (SELECT doc_id::VARCHAR AS id, model, F1 AS value, row_number() OVER (ORDER BY doc_id::VARCHAR, model)::INT AS place FROM scored) SELECT id, model, value, place FROM l WHERE place <= 5")
def compare_examples(s, d):
    return compare.examples(_structure(s, d).filter("suffix = 'F1'")).select("id", "model", "value", "place")


@query(f"WITH {PATHS_SQL} SELECT doc_id::VARCHAR AS id, max(F1) FILTER (model = 'm1') AS m1, max(F1) FILTER (model = 'm2') AS m2, max(F1) FILTER (model = 'm3') AS m3 FROM scored GROUP BY 1")
def compare_models_view(s, d):
    return compare.compare_models_view(_structure(s, d), list(MODELS), compare.STRUCTURE).drop("metric")


@query(None)
def compare_all_metrics(s, d):
    """Every metric over every field; texts of documents against their neighbours' first lines."""
    plan = compare.MetricPlan({"rouge": [compare.GLOBAL, "lang"], "rouge2": ["source"], "levenshtein": [compare.GLOBAL, "source"], "bertscore": ["source"], "sbert_pequeno": [compare.GLOBAL]})
    return compare.compare(extractions(s, d), plan)


@query(f"WITH {LOG_SQL} SELECT run, step, loss, round(rank() OVER (PARTITION BY run ORDER BY loss DESC) + (count(*) OVER (PARTITION BY run, loss) - 1) / 2, 1) AS rank FROM log")
def series_average_rank(s, d):
    return log(s, d).select("run", "step", "loss", r(series.average_rank("loss", ["run"]), 1).alias("rank"))


@query(f"WITH {LOG_SQL} SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS ma3, round(CASE WHEN count(loss) OVER w = 10 THEN avg(loss) OVER w END, 4) AS ma10 FROM log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def series_moving_averages(s, d):
    return log(s, d).select("run", "step", r(series.moving_average("loss", "step", ["run"], 1, 1)).alias("ma3"), r(series.moving_average("loss", "step", ["run"], 9, full=True)).alias("ma10"))


@query(f"WITH {LOG_SQL}, x AS (SELECT run, step, lag(loss) OVER w - loss AS a, tokens - lag(tokens) OVER w AS b FROM log WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, step, round(a, 2) AS d_loss, b AS d_tokens, b > 0 AS counted FROM x")
def series_efficiency(s, d):
    return series.marginal_efficiency(log(s, d), "step", "loss", "tokens", ["run"]).select("run", "step", r("d_loss", 2).alias("d_loss"), "d_tokens", F.when(F.col("d_tokens").isNotNull(), F.col("efficiency").isNotNull()).alias("counted"))


@query(f"WITH {LOG_SQL} SELECT run, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, round(arg_min(loss, step) - arg_max(loss, step), 4) AS d_loss, CASE WHEN arg_max(tokens, step) > arg_min(tokens, step) THEN arg_max(tokens, step) - arg_min(tokens, step) ELSE arg_max(tokens, step) END AS tokens FROM log GROUP BY run")
def series_stage_deltas(s, d):
    return series.stage_deltas(log(s, d), "step", "loss", "tokens", ["run"]).withColumn("d_loss", r("d_loss"))


@query(f"WITH {LOG_SQL}, x AS (SELECT run, step, epoch, lag(step) OVER w AS s0, lag(epoch) OVER w AS e0 FROM log WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, m.marker::BIGINT AS marker, round(s0 + (m.marker - e0) / (epoch - e0) * (step - s0), 4) AS at_step FROM x, unnest(range((floor(e0) + 1)::BIGINT, floor(epoch)::BIGINT + 1)) m(marker) WHERE floor(e0) < floor(epoch)")
def series_epoch_markers(s, d):
    return series.epoch_markers(log(s, d), "step", "epoch", ["run"]).withColumn("at_step", r("at_step"))


@query(f"WITH {LOG_SQL}, x AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM log), k AS (SELECT *, floor(i * 9 / greatest(n - 1, 1)) AS k FROM x) SELECT run, step FROM k WHERE n <= 10 OR i = ceil(k * (n - 1) / 9)")
def series_downsample(s, d):
    return series.downsample(log(s, d), "step", 10, ["run"]).select("run", "step")


@query(f"WITH {LOG_SQL} SELECT run, (min({{l: eval_loss, s: step}})).s AS best_step, (min({{l: eval_loss, s: step}})).l AS best_loss FROM log WHERE eval_loss IS NOT NULL GROUP BY run")
def series_best_point(s, d):
    return series.best_point(log(s, d), "eval_loss", "step", ["run"])


@query(f"WITH {LOG_SQL}, c AS (SELECT run, step, eval_loss, last_value(CASE WHEN step % 2 = 0 THEN tokens END IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM log), b AS (SELECT run, min({{l: eval_loss, s: step}}) AS b FROM c WHERE eval_loss IS NOT NULL GROUP BY run) SELECT b.run, b.b.s AS best_step, b.b.l AS best_loss, c.t AS tokens FROM b JOIN c ON c.run = b.run AND c.step = b.b.s")
def series_best_cost(s, d):
    own = log(s, d).withColumn("tokens", F.when(F.col("step") % 2 == 0, F.col("tokens")))
    return series.best_cost_point(own, "step", "eval_loss", ["tokens"], ["run"])


@query(f"WITH {LOG_SQL}, x AS (SELECT run, epoch, last_value(eval_loss IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM log) SELECT run, min(epoch) AS stop_epoch FROM x WHERE epoch >= 1 AND l < 5 GROUP BY run")
def series_early_stop(s, d):
    return series.early_stop(log(s, d), "epoch", "eval_loss", 1, 5, ["run"])


@query("WITH sp AS (SELECT n_nationkey AS ord, n_name AS alias, (n_nationkey + 3) * 10 AS n, n_nationkey % 3 + 1 AS pace FROM nation), e AS (SELECT ord, alias, n, r.rep FROM sp, range(1, pace + 1) r(rep)), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ord, rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e) SELECT ord, alias, rep::INT AS rep, n, start, (start + n)::BIGINT AS \"end\", (start // 16)::BIGINT AS first_step FROM o".replace("FROM sp, range(1, pace + 1) r(rep)", "FROM sp, unnest(range(1, pace + 1)) r(rep)"))
def series_stream_spans(s, d):
    n = F.col("n_nationkey")
    return series.stream_spans(table(s, d, "nation").select(n.alias("ord"), F.col("n_name").alias("alias"), ((n + 3) * 10).alias("n"), (n % 3 + 1).cast("int").alias("pace")), 16)


@query(f"WITH {LOG_SQL} SELECT run, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, round(100 * (arg_min(loss, step) - arg_max(loss, step)) / nullif(arg_min(loss, step), 0), 3) AS reduction_pct, round(max(tokens) / max(seconds), 3) AS tokens_per_second FROM log GROUP BY run")
def series_consolidated(s, d):
    return series.consolidated(log(s, d), ["run"], "step", "loss", "tokens", "seconds").drop("saved_per_mtoken")


DIFFICULTY_SQL = """
WITH x AS (SELECT doc_id, lang, coalesce(CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 10) / 10 END, avg(CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 10) / 10 END) OVER w, 0)
  - coalesce((n_chars - min(n_chars) OVER w) / nullif(max(n_chars) OVER w - min(n_chars) OVER w, 0), 0) AS score FROM documents WINDOW w AS (PARTITION BY lang)),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM x)
"""


@query(DIFFICULTY_SQL + "SELECT lang, doc_id, CASE WHEN i <= floor(n * 0.3) THEN 'dificil' WHEN i <= floor(n * 0.7) THEN 'medio' ELSE 'facil' END AS dificuldade FROM p")
def split_difficulty(s, d):
    own = table(s, d, "documents").withColumn("f1", F.when(F.col("doc_id") % 6 != 0, (F.col("doc_id") % 10) / 10))
    return splits.difficulty_split(own, ["lang"], "doc_id", ["f1"], "n_chars").select("lang", "doc_id", "dificuldade")


HASHED = "md5(o_orderkey::VARCHAR || '|42')"


@query(f"WITH x AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASHED}, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN i <= floor(n * 0.7) THEN 'treino' WHEN i <= floor(n * 0.7) + floor(n * 0.2) THEN 'teste' ELSE 'validacao' END AS alvo FROM x")
def split_targets(s, d):
    return splits.target_split(table(s, d, "orders"), ["o_orderstatus"], "o_orderkey", splits.ratios({"treino": 70, "teste": 20, "validacao": 10})).select("o_orderkey", "o_orderstatus", "alvo")


@query(f"SELECT o_orderkey, 'b' || ((row_number() OVER (ORDER BY {HASHED}, o_orderkey) - 1) % 3 + 1) AS bloco FROM orders")
def split_blocks(s, d):
    return splits.balanced_blocks(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {HASHED}, o_orderkey) <= 5")
def split_stratified_sample(s, d):
    return splits.stratified_sample(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 5).select("o_orderkey", "o_orderstatus", "o_orderpriority")


STAGES_SQL = "st AS (SELECT l_linenumber AS ord, 's' || l_linenumber AS alias, l_orderkey AS id, CASE WHEN l_quantity > 25 THEN 'treino' ELSE 'validacao' END AS alvo FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"


def _stages(s, d):
    from ..operators.joins import first_wins

    own = table(s, d, "lineitem").withColumn("_k", F.concat_ws("-", "l_linenumber", "l_orderkey"))
    own = first_wins(own, "_k", ["l_partkey", "l_suppkey", "l_quantity"]).filter("copy = 1")
    return own.select(F.col("l_linenumber").alias("ord"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("alias"), F.col("l_orderkey").alias("id"), F.when(F.col("l_quantity") > 25, "treino").otherwise("validacao").alias("alvo"))


@query(f"WITH {STAGES_SQL} SELECT id, arg_min(alvo, ord) AS alvo, array_to_string(list_sort(list(DISTINCT alias)), ',') AS divisoes FROM st GROUP BY id")
def split_unified(s, d):
    return splits.unified_split(_stages(s, d)).withColumn("divisoes", F.array_join("divisoes", ","))


@query(f"WITH {STAGES_SQL}, v AS (SELECT alias, count(DISTINCT id) AS n FROM st WHERE alvo = 'validacao' GROUP BY 1), u AS (SELECT count(DISTINCT id) AS n_union FROM st WHERE alvo = 'validacao') SELECT bool_or(n <> n_union) AS needed, max(n_union) AS n_union FROM v, u")
def split_eval_global(s, d):
    return splits.eval_global_needed(_stages(s, d))


@query("WITH f AS (SELECT lang, source, min(doc_id) AS f FROM documents GROUP BY 1, 2), k AS (SELECT lang, source FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f, source) <= 3) SELECT doc_id, lang, source FROM documents JOIN k USING (lang, source)")
def split_limit_per_group(s, d):
    return splits.limit_per_group(table(s, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 3)


@query("SELECT alvo, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN l_quantity > 25 THEN 'treino' ELSE 'validacao' END AS alvo FROM lineitem) GROUP BY 1")
def split_proportions(s, d):
    from pyspark.sql import Window

    own = table(s, d, "lineitem").groupBy(F.when(F.col("l_quantity") > 25, "treino").otherwise("validacao").alias("alvo")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("alvo", r(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT l_returnflag AS source, l_linestatus AS rater, count(*) AS n, count(*) FILTER (l_quantity < 5) AS failures, round(100.0 * count(*) FILTER (l_quantity < 5) / count(*), 3) AS rate_pct FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agree_failures(s, d):
    li = table(s, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("rater"), "l_quantity")
    return agreement.failure_table(li, "source", "rater", F.col("l_quantity") < 5)


@query(f"WITH {NOTES_SQL}, p AS (SELECT doc, median(note) FILTER (source = 'A') AS a, median(note) FILTER (source = 'N') AS n, median(note) FILTER (source = 'R') AS r FROM notes GROUP BY doc) SELECT doc, a, n, r FROM p WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
def agree_median_pivot(s, d):
    return agreement.median_pivot(notes(s, d), ["doc"], "source", ["A", "N", "R"], "note").select("doc", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query(f"WITH {NOTES_SQL} SELECT doc, source, max(note) - min(note) AS amplitude FROM notes GROUP BY 1, 2 HAVING max(note) - min(note) > 2")
def agree_ambiguous(s, d):
    return agreement.ambiguous(notes(s, d), ["doc", "source"], "note")


Z = normal_quantile(0.975)


@query(f"WITH {NOTES_SQL}, g AS (SELECT source, count(note) AS n, round(avg(note), 4) AS mean, median(note) AS median, round(stddev_samp(note), 4) AS sd, quantile_cont(note, 0.25) AS q1, quantile_cont(note, 0.75) AS q3, min(note) AS min, max(note) AS max, count(*) FILTER (note >= 3) / count(note) AS p FROM notes GROUP BY 1) SELECT source, n, mean, median, sd, q1, q3, min, max, round(p, 4) AS share, round((p + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)) / (1 + {Z}*{Z}/n), 4) AS low, round((p + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)) / (1 + {Z}*{Z}/n), 4) AS high FROM g")
def agree_descriptives(s, d):
    own = agreement.source_descriptives(notes(s, d), "source", "note")
    return own.withColumns({c: r(c) for c in ("mean", "sd", "share", "low", "high")})


def _two(s, d):
    return notes(s, d).groupBy("doc", "source").pivot("rater", [1, 2, 3]).agg(F.first("note")).select("doc", "source", F.col("1").alias("a"), F.col("2").alias("b"), F.col("3").alias("c"))


TWO_SQL = f"{NOTES_SQL}, two AS (SELECT doc, source, max(note) FILTER (rater = 1) AS a, max(note) FILTER (rater = 2) AS b, max(note) FILTER (rater = 3) AS c FROM notes GROUP BY 1, 2)"


@query(f"WITH {TWO_SQL}, g AS (SELECT x.i AS a, y.i AS b FROM (VALUES (1), (2), (3), (4)) x(i), (VALUES (1), (2), (3), (4)) y(i)) SELECT g.a, g.b, count(two.doc) AS n FROM g LEFT JOIN two ON two.a = g.a AND two.b = g.b GROUP BY 1, 2")
def agree_confusion(s, d):
    return agreement.confusion(_two(s, d), "a", "b", [1, 2, 3, 4])


@query(f"WITH {TWO_SQL}, t AS (SELECT a, b FROM two WHERE a IS NOT NULL AND b IS NOT NULL), o AS (SELECT count(*) AS n, avg(1 - ((a - b) / 3) ** 2) AS po FROM t), e AS (SELECT avg(1 - ((x.a - y.b) / 3) ** 2) AS pe FROM t x, t y) SELECT n, round(po, 4) AS p_o, round(pe, 4) AS p_e, round((po - pe) / (1 - pe), 4) AS kappa FROM o, e")
def agree_cohen(s, d):
    return agreement.cohen_weighted(_two(s, d), "a", "b", [1, 2, 3, 4]).withColumns({c: r(c) for c in ("p_o", "p_e", "kappa")})


@query(f"WITH {NOTES_SQL}, i AS (SELECT doc, source, count(*) AS m FROM notes GROUP BY 1, 2 HAVING count(*) > 1), n AS (SELECT notes.* FROM notes JOIN i USING (doc, source)), w AS (SELECT x.doc, x.source, avg(1 - ((x.note - y.note) / 3) ** 2) AS a FROM n x JOIN n y ON x.doc = y.doc AND x.source = y.source AND x.rater <> y.rater GROUP BY 1, 2), c AS (SELECT note, count(*) / (SELECT count(*) FROM n) AS p FROM n GROUP BY 1), e AS (SELECT sum(x.p * y.p * (1 - ((x.note - y.note) / 3) ** 2)) AS pe FROM c x, c y), o AS (SELECT count(*) AS n_items, avg(a) AS po FROM w) SELECT n_items, round(po, 4) AS p_o, round(pe, 4) AS p_e, round((po - pe) / (1 - pe), 4) AS kappa FROM o, e")
def agree_fleiss(s, d):
    return agreement.fleiss_weighted(notes(s, d), ["doc", "source"], "note", [1, 2, 3, 4]).withColumns({c: r(c) for c in ("p_o", "p_e", "kappa")})


@query("SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / nullif(tp + fn, 0), 4) AS sensitivity, round(tn / nullif(tn + fp, 0), 4) AS specificity FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)")
def agree_binary(s, d):
    own = agreement.binary_metrics(table(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return own.withColumns({c: r(c) for c in ("accuracy", "sensitivity", "specificity")})


@query("SELECT b, c, round((abs(b - c) - 1) ** 2 / nullif(b + c, 0), 4) AS statistic FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels)")
def agree_mcnemar(s, d):
    return agreement.mcnemar_statistic(table(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1).withColumn("statistic", r("statistic"))


@query("SELECT event_type AS source, k AS problem, count(*) AS n FROM (SELECT event_type, unnest(string_split(props, ' ')) AS k FROM events) GROUP BY 1, 2")
def agree_problem_frequency(s, d):
    return agreement.problem_frequency(table(s, d, "events").select(F.col("event_type").alias("source"), F.split("props", " ").alias("p")), "source", "p")


@query("SELECT event_type, round(avg(event_id), 4) AS mean_tokens, sum(event_id)::BIGINT AS sum_tokens, round(avg(value), 4) AS mean_seconds, round(sum(value), 2) AS sum_seconds FROM events GROUP BY 1")
def agree_cost(s, d):
    own = agreement.evaluation_cost(table(s, d, "events"), ["event_type"], "event_id", "value")
    return own.withColumns({"mean_tokens": r("mean_tokens"), "mean_seconds": r("mean_seconds"), "sum_seconds": r("sum_seconds", 2)})


@query(None)
def agree_bootstrap(s, d):
    own = notes(s, d).withColumn("doc", F.col("doc").cast("string"))
    return agreement.block_bootstrap(own, "doc", {"k": F.count_if(F.col("note") >= 3), "n": F.count(F.lit(1))}, F.try_divide("k", "n"), replicas=200)


def _whole(s, d):
    own = scores(s, d)
    return frequentist.complete_rows(own, own.select("protocol").distinct().count())


@query(f"WITH {SCORES_SQL} SELECT protocol, count(*) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(avg(rank), 9) AS mean_rank, round(avg((value = 1)::INT), 9) AS share_one FROM ranked GROUP BY 1")
def stats_ranking(s, d):
    return frequentist.ranking(_whole(s, d)).select("protocol", "n", *(r(c, 9).alias(c) for c in ("mean", "median", "mean_rank", "share_one")))


@query(f"WITH {SCORES_SQL}, g AS (SELECT protocol, sum(rank) AS s, sum(rank * rank) AS q, count(*) AS n FROM ranked GROUP BY 1), t AS (SELECT max(n) AS n, count(*) AS k, (sum(s * s) - sum(s) ** 2 / count(*)) / max(n) AS b, (sum(q) - max(n) * count(*) * (count(*) + 1) ** 2 / 4) / (max(n) * (count(*) - 1)) AS w FROM g) SELECT n, k, round(b / w, 4) AS chi2, round(b / w / (n * (k - 1)), 4) AS kendall_w FROM t")
def stats_friedman(s, d):
    return frequentist.friedman_frame(_whole(s, d)).withColumns({"chi2": r("chi2"), "kendall_w": r("kendall_w")})


WILCOXON_SQL = f"""WITH {SCORES_SQL}, d AS (SELECT x.protocol AS a, y.protocol AS b, round(x.value - y.value, 12) AS d FROM whole x JOIN whole y ON x.doc = y.doc AND x.protocol < y.protocol),
z AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS k FROM d WHERE d <> 0),
t AS (SELECT a, b, sum(n * n * n - n) AS tie FROM (SELECT a, b, count(*)::DOUBLE AS n FROM d WHERE d <> 0 GROUP BY a, b, abs(d)) GROUP BY 1, 2),
s AS (SELECT a, b, count(*) AS m, coalesce(sum(k) FILTER (d > 0), 0) AS plus, coalesce(sum(k) FILTER (d < 0), 0) AS minus FROM z GROUP BY 1, 2),
w AS (SELECT a, b, count(*) AS n, median(d) AS md, avg((d = 0)::INT) AS ts FROM d GROUP BY 1, 2)
SELECT a, b, n, round(plus, 1) AS plus, round(minus, 1) AS minus, round(abs((least(plus, minus) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - tie / 48)), 4) AS z, round(md, 6) AS median_delta, round(ts, 4) AS tie_share
FROM w JOIN s USING (a, b) JOIN t USING (a, b)"""


@query(WILCOXON_SQL)
def stats_wilcoxon(s, d):
    own = frequentist.wilcoxon_sums(frequentist.pair_deltas(_whole(s, d)))
    return own.select("a", "b", "n", r("plus", 1).alias("plus"), r("minus", 1).alias("minus"), r("z").alias("z"), r("median_delta", 6).alias("median_delta"), r("tie_share").alias("tie_share"))


@query("WITH p AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) / 1000.0 AS p, p_partkey FROM part), s AS (SELECT *, p * (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) AS st FROM p) SELECT p_brand, p_partkey, round(least(1, max(st) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4)::DOUBLE AS p_holm FROM s")
def stats_holm(s, d):
    from pyspark.sql import Window

    own = table(s, d, "part").withColumn("p", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) / F.lit(1000.0))
    return frequentist.with_holm(own, "p", ["p_partkey"], ["p_brand"]).select("p_brand", "p_partkey", r("p_holm").alias("p_holm"))


@query(f"WITH {SCORES_SQL}, d AS (SELECT x.protocol AS a, y.protocol AS b, x.value - y.value AS d FROM whole x JOIN whole y ON x.doc = y.doc AND x.protocol < y.protocol) SELECT a, b, round(avg(d) / stddev_samp(d), 4) AS d FROM d GROUP BY 1, 2")
def stats_cohen_d(s, d):
    return frequentist.cohen_d(frequentist.pair_deltas(_whole(s, d))).select("a", "b", r("d").alias("d"))


@query(f"WITH {SCORES_SQL}, d AS (SELECT x.protocol AS a, y.protocol AS b, x.value - y.value AS d FROM whole x JOIN whole y ON x.doc = y.doc AND x.protocol < y.protocol) SELECT a, b, count(*) AS n, count(*) FILTER (d > 0.01) AS wins, count(*) FILTER (abs(d) <= 0.01) AS ties, count(*) FILTER (d < -0.01) AS losses, round(avg(d), 6) AS mean FROM d GROUP BY 1, 2")
def stats_bayes_counts(s, d):
    return bayes.counts(frequentist.pair_deltas(_whole(s, d)), 0.01).select("a", "b", "n", "wins", "ties", "losses", r("mean", 6).alias("mean"))


@query(None)
def stats_bayes_matrix(s, d):
    rows = bayes.matrix(_whole(s, d), 0.01)
    return s.createDataFrame(rows, "linha string, coluna string, n bigint, metodo string, rope double, p_esquerda double, p_rope double, p_direita double, diferenca_media double, classificacao string, probabilidade double")


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def extension_tumbling(s, d):
    own = streams.windowed(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return own.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", r("total", 2).alias("total"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x), c AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1")
def extension_sessions(s, d):
    own = streams.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def extension_rollup(s, d):
    return table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
