"""Chat formatting: tool-call linking with DataFrame and SQL functions only.

``link_tool_calls`` hash-joins calls and results by identifier, orders the
calls of a conversation so that each follows those it depends on, checks the
arguments against the tools' schemas, and writes one canonical JSON text
(keys sorted, no white space) per call.  A conversation is never gathered
into one row or one window: the order is a column.

Order.  ``step`` is the length of the longest way from a call to one without
dependencies, so a call comes after all that it depends on.  Calls with one
dependency form chains, which pointer doubling shortens in log(length) rounds;
only calls with several dependencies are then freed level by level.  What never
becomes free is part of a cycle or behind one (``step`` null).

Cases: a null identifier links with nothing: its call is a row with the error
"no identifier"; results of no call are rows with the error "result without a
call"; a call id that occurs again keeps its smallest (turn, name, arguments),
a result id its smallest text, and the numbers of occurrences are reported;
dependencies on absent calls are listed as errors and do not block; null or
malformed arguments are errors; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: tool -> field -> (JSON type, required, smallest, largest)
Schemas = dict[str, dict[str, tuple[str, bool, float | None, float | None]]]

TOOLS: Schemas = {
    "search": {"query": ("STRING", True, None, None), "n_words": ("BIGINT", True, 1, 64)},
    "summarise": {"query": ("STRING", True, None, None), "n_words": ("BIGINT", True, 1, 400), "style": ("STRING", False, None, None)},
    "translate": {"query": ("STRING", True, None, None), "n_words": ("BIGINT", True, 1, None), "target": ("STRING", True, None, None)},
}


def argument_errors(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """A sorted array of messages; empty for valid arguments."""
    value = F.try_parse_json(arguments)

    def of_tool(fields: dict) -> Column:
        checks = [F.when(F.size(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(fields))))) > 0, F.lit("unknown field"))]
        for field, (kind, required, least, most) in sorted(fields.items()):
            found = F.expr(f"schema_of_variant(variant_get(_v, '$.{field}', 'variant'))")
            missing = found.isNull() | (found == "VOID")
            if required:
                checks.append(F.when(missing, F.lit(f"{field} is missing")))
            checks.append(F.when(~missing & (found != kind), F.lit(f"{field} is not {kind}")))
            if least is not None or most is not None:
                number = F.expr(f"try_variant_get(_v, '$.{field}', 'double')")
                low = number < least if least is not None else F.lit(False)
                high = number > most if most is not None else F.lit(False)
                checks.append(F.when((found == kind) & (low | high), F.lit(f"{field} is out of range")))
        return F.array_sort(F.array_compact(F.array(*checks)))

    per_tool = reduce(lambda so_far, item: so_far.when(name == item[0], of_tool(item[1])), schemas.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    return F.when(value.isNull() | ~F.expr("schema_of_variant(_v)").startswith("OBJECT"), F.array(F.lit("arguments are not an object"))).otherwise(
        per_tool.otherwise(F.array(F.lit("unknown tool")))
    )


def _levels(edges: DataFrame) -> DataFrame:
    """(call_id, step) of every call with a dependency, from distinct (call_id, dependency)."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges)
    degrees = scratch.keep(edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dependency").alias("at")))
    chain = scratch.keep(degrees.filter("n = 1").select("call_id", "at", F.lit(1).cast("bigint").alias("reach"), F.lit(True).alias("moved")))
    # twice the reach a round; what still moves when the reach exceeds the number of calls runs in a circle
    rounds = chain.count().bit_length()
    for _ in range(rounds):
        hop = chain.select(F.col("call_id").alias("at"), F.col("at").alias("_at"), F.col("reach").alias("_reach"))
        longer = chain.join(hop, "at", "left").select("call_id", F.coalesce("_at", "at").alias("at"), (F.col("reach") + F.coalesce("_reach", F.lit(0))).alias("reach"), F.col("_at").isNotNull().alias("moved"))
        longer = scratch.keep(longer)
        scratch.drop(chain)
        chain = longer
        if chain.filter("moved").isEmpty():
            break
    # an end is a call without dependencies (level 0), with several (level open), or on a circle (never)
    roots = edges.select(F.col("dependency").alias("at")).distinct().join(degrees.select(F.col("call_id").alias("at")), "at", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    roots = scratch.keep(roots)
    several = edges.join(degrees.filter("n > 1").select("call_id"), "call_id", "left_semi")
    ways = several.join(chain.select(F.col("call_id").alias("dependency"), "at", "reach"), "dependency", "left")
    ways = ways.select("call_id", F.coalesce("at", "dependency").alias("at"), (F.coalesce("reach", F.lit(0)) + 1).alias("reach"))
    waiting = scratch.keep(ways.join(roots, "at", "left").select("call_id", "at", "reach", (F.col("level") + F.col("reach")).alias("value")))
    done = []
    while True:
        free = waiting.groupBy("call_id").agg(F.max("value").alias("level"), F.count_if(F.col("value").isNull()).alias("open")).filter("open = 0")
        free = scratch.keep(free.select("call_id", "level"))
        if free.isEmpty():
            break
        done.append(free)
        reached = free.select(F.col("call_id").alias("at"), "level")
        left = waiting.join(free, "call_id", "left_anti").join(reached, "at", "left").select("call_id", "at", "reach", F.coalesce("value", F.col("level") + F.col("reach")).alias("value"))
        left = scratch.keep(left)
        scratch.drop(waiting)
        waiting = left
    found = reduce(lambda a, b: a.unionByName(b), done) if done else degrees.limit(0).select("call_id", F.col("n").alias("level"))
    ends = roots.unionByName(found.withColumnRenamed("call_id", "at"))
    chained = chain.join(ends, "at", "left").select("call_id", (F.col("level") + F.col("reach")).alias("step"))
    return chained.unionByName(degrees.filter("n > 1").select("call_id").join(found, "call_id", "left").withColumnRenamed("level", "step"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls (conv_id, turn, call_id, name, arguments, depends_on array<string>) and results (call_id, content)
    -> conv_id, turn, step, call_id, name, n_calls, n_results, errors, valid, json."""
    own = (
        calls.filter(F.col("call_id").isNotNull())
        .groupBy("call_id")
        .agg(F.min(F.struct("turn", "name", "arguments", "conv_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("c"), F.count(F.lit(1)).alias("n_calls"))
        .select("call_id", "c.*", "n_calls")
    )
    answers = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("n_results"))
    edges = own.select("call_id", F.explode(F.array_distinct("depends_on")).alias("dependency"))
    known = edges.join(own.select(F.col("call_id").alias("dependency"), F.lit(True).alias("_known")), "dependency", "left")
    gaps = known.filter("_known is null").select("call_id").distinct().withColumn("_absent", F.lit(True))
    levels = _levels(known.filter("_known").select("call_id", "dependency")).withColumn("_deep", F.lit(True))
    linked = own.join(gaps, "call_id", "left").join(levels, "call_id", "left").withColumn("step", F.when(F.col("_deep"), F.col("step")).otherwise(0))
    linked = linked.join(answers, "call_id", "full")
    # rows without an identifier meet nothing, so they stay out of the joins
    nameless = calls.filter(F.col("call_id").isNull()).select("conv_id", "turn", "call_id", "name", "arguments", F.lit(1).cast("bigint").alias("n_calls"))
    stray = results.filter(F.col("call_id").isNull()).select("call_id", F.col("content").alias("result"), F.lit(1).cast("bigint").alias("n_results"))
    linked = linked.unionByName(nameless, allowMissingColumns=True).unionByName(stray, allowMissingColumns=True)
    linked = linked.withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).withColumn("_v", F.try_parse_json("arguments"))
    say = lambda when, what: F.when(when, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    found = F.concat(argument_errors(F.col("arguments"), F.col("name"), schemas), say(F.col("_absent"), "dependency is absent"), say(F.col("call_id").isNull(), "no identifier"))
    linked = linked.withColumn("errors", F.when(F.col("n_calls") > 0, found).otherwise(F.array(F.lit("result without a call"))))
    linked = linked.withColumn("valid", F.size("errors") == 0)
    quoted = lambda c: F.coalesce(F.substring(F.to_json(F.struct(F.col(c).alias("x"))), 6, 1 << 30), F.lit("null}"))  # noqa: E731  {"x":...} without its head
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.expr("left(_q, length(_q) - 1)".replace("_q", f"_q_{c}")))
    for c in ("call_id", "name", "result"):
        linked = linked.withColumn(f"_q_{c}", quoted(c))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    # keys in order; a variant's own text has its keys sorted
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_v"), F.lit("null")), F.lit(',"call_id":'), text("call_id"), F.lit(',"conv_id":'), number("conv_id"), F.lit(',"name":'), text("name"),
        F.lit(',"result":'), text("result"), F.lit(',"step":'), number("step"), F.lit(',"valid":'), F.col("valid").cast("string"), F.lit("}"),
    )
    return linked.select("conv_id", "turn", "step", "call_id", "name", "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.concat_ws("; ", "errors").alias("errors"), "valid", canonical.alias("json"))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call whose tool follows from its length, every assistant turn as the result of the turn before.

    Of two calls two turns apart the shorter depends on the longer, of equal ones the later on the earlier; a call
    from turn 2 on depends on the one before also where that is missing.
    """
    size, words = F.length("text"), F.expr("size(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != ''))")
    name = F.when(size < 200, "search").when(size < 900, "summarise").otherwise("translate")
    identifier = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.cast("bigint").alias("n_words"), F.when(name == "summarise", "short").alias("style"), F.when((name == "translate") & (F.col("conv_id") % 3 != 0), "en").alias("target")))
    turn = F.col("turn")
    asked = conversations.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    sizes = asked.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce(F.length("text"), F.lit(0))).alias("own"))
    beside = lambda by, c: sizes.select("conv_id", (turn + by).alias("turn"), F.col("own").alias(c))
    near = sizes.join(beside(2, "earlier"), ["conv_id", "turn"], "left").join(beside(-2, "later"), ["conv_id", "turn"], "left")
    back = F.when((turn >= 2) & F.coalesce(F.col("earlier") >= F.col("own"), F.lit(True)), identifier(turn - 2))
    ahead = F.when((turn >= 0) & (F.col("later") > F.col("own")), identifier(turn + 2))
    near = near.select("conv_id", "turn", F.array_compact(F.array(back, ahead)).alias("depends_on"))
    calls = asked.join(near, ["conv_id", "turn"], "left").select("conv_id", "turn", identifier(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), "depends_on")
    results = conversations.filter(F.col("role") == "assistant").select(identifier(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*calls_of(table(spark, sf_dir, "conversations")), TOOLS)


OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT *, length(text) AS n, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations),
z AS (SELECT conv_id, turn, min(coalesce(length(text), 0)) AS own FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
dep AS (
  SELECT z.conv_id, z.turn, z.turn - 2 AS dependency, y.turn IS NULL AS absent FROM z LEFT JOIN z y ON y.conv_id = z.conv_id AND y.turn = z.turn - 2 WHERE z.turn >= 2 AND coalesce(y.own >= z.own, true)
  UNION ALL SELECT z.conv_id, z.turn, y.turn, false FROM z JOIN z y ON y.conv_id = z.conv_id AND y.turn = z.turn + 2 WHERE z.turn >= 0 AND y.own > z.own),
way(conv_id, turn, place, n) AS (
  SELECT conv_id, turn, turn, 0::BIGINT FROM z UNION ALL SELECT way.conv_id, way.turn, dep.dependency, n + 1 FROM way JOIN dep ON dep.conv_id = way.conv_id AND dep.turn = way.place AND NOT dep.absent),
lv AS (SELECT conv_id, turn, max(n) AS step FROM way GROUP BY 1, 2),
gap AS (SELECT DISTINCT conv_id, turn FROM dep WHERE absent),
c0 AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, text, words,
    CASE WHEN n < 200 THEN 'search' WHEN n < 900 THEN 'summarise' ELSE 'translate' END AS name FROM t WHERE role = 'user'),
c AS (SELECT call_id, min(conv_id) AS conv_id, min(turn) AS turn, min({name: name, text: text, words: words}) AS r, count(*) AS n_calls FROM c0 WHERE call_id IS NOT NULL GROUP BY call_id
  UNION ALL SELECT call_id, conv_id, turn, {name: name, text: text, words: words}, 1 FROM c0 WHERE call_id IS NULL),
a0 AS (SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
a AS (SELECT call_id, min(text) AS result, count(*) AS n_results FROM a0 WHERE call_id IS NOT NULL GROUP BY 1 UNION ALL SELECT call_id, text, 1 FROM a0 WHERE call_id IS NULL),
j AS (
  SELECT coalesce(c.call_id, a.call_id) AS call_id, c.conv_id, c.turn, c.r.name AS name, c.r.text AS text, c.r.words AS words, coalesce(c.n_calls, 0) AS n_calls, coalesce(a.n_results, 0) AS n_results, a.result,
    c.r.name = 'translate' AND c.conv_id % 3 <> 0 AS targeted
  FROM c FULL JOIN a ON a.call_id = c.call_id),
e AS (
  SELECT j.*, lv.step, CASE WHEN n_calls = 0 THEN 'result without a call' ELSE concat_ws('; ',
    CASE WHEN name = 'search' AND (words < 1 OR words > 64) OR name = 'summarise' AND (words < 1 OR words > 400) OR name = 'translate' AND words < 1 THEN 'n_words is out of range' END,
    CASE WHEN text IS NULL THEN 'query is missing' END,
    CASE WHEN name = 'translate' AND targeted IS NOT TRUE THEN 'target is missing' END,
    CASE WHEN gap.turn IS NOT NULL THEN 'dependency is absent' END,
    CASE WHEN call_id IS NULL THEN 'no identifier' END) END AS errors
  FROM j LEFT JOIN lv ON lv.conv_id = j.conv_id AND lv.turn = j.turn LEFT JOIN gap ON gap.conv_id = j.conv_id AND gap.turn = j.turn)
SELECT conv_id, turn, step, call_id, name, n_calls, n_results, errors, errors = '' AS valid,
  '{"arguments":' || CASE WHEN n_calls = 0 THEN 'null' ELSE '{"n_words":' || words || CASE WHEN text IS NULL THEN '' ELSE ',"query":' || to_json(text) END
    || CASE WHEN name = 'summarise' THEN ',"style":"short"' WHEN targeted THEN ',"target":"en"' ELSE '' END || '}' END
    || ',"call_id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"conv_id":' || coalesce(conv_id::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"step":' || coalesce(step::VARCHAR, 'null') || ',"valid":' || (errors = '') || '}' AS json
FROM e
"""
