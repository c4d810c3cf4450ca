"""Quality rules: distribution divergence, with DataFrame and SQL functions only.

Two histograms of a document are compared with the references of every
language by the Jensen-Shannon distance (base 2, 0 to 1): character classes,
and the languages' common words plus one bin for all other words.  The
references are the sums over all documents of a language.  The nearest
language by words decides; a document fails when either distance is above
its threshold.  Guards: the word distance counts from ``MIN_WORDS`` words on,
the class distance from ``MIN_CHARS`` characters on.  The threshold of the word
distance grows as the words get fewer than ``FULL_WORDS``, by the distance that
sampling adds (its square falls with the number of words).

A word is common when it makes up 1/250 of its language's words or more, so
there are at most 250 a language; languages count from 1/500 of all words
with a language on, which bounds the tables that are collected and sent out.
Common words are runs of letters and marks of any script and any length,
compared as they are written; all others fall into the bin for other words.

Cases: a null or empty text has no words and fails the base rule; without
references (an empty table, no language known) the divergence rules pass;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
COMMON_SHARE, LANGUAGES = 1 / 250, 500
COMMON_WORD = r"[\p{L}\p{M}]+"
MIN_WORDS, FULL_WORDS, MIN_CHARS = 50, 120, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.25
#: The sampling part of a squared distance times the number of words.
SAMPLING = 1.75
#: Removed one after another; what is left is the last class.
CLASSES = (
    ("space", SPACE), ("consonant", "[b-df-hj-np-tv-z]+"), ("vowel", "[aeiou]+"), ("letter", r"[^\x00-\x7F]+"), ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("stop", "[.,]+"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first occurrence included."""
    n = F.size(words) - (window - 1)
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def marked(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"])))
            return F.sort_array(F.transform(same, lambda x: x["p"]))

        def covered(p: Column) -> Column:
            steps = F.transform(F.slice(p, 2, F.size(p)), lambda x, i: F.least(F.lit(window), x - p[i]))
            return F.aggregate(steps, F.lit(window), lambda a, x: a + x)

        return let(let(ordered, positions), covered)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h))).cast("bigint")


def features(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Id, language, words and the counts that need one pass over the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), text.alias("_text"), words_of(F.col(text_col)).alias("_words"))
    # one projection per step: each removal is used twice and computed once
    out = out.withColumn("_rest0", F.col("_text"))
    for k, (_, pattern) in enumerate(CLASSES):
        out = out.select("*", F.regexp_replace(f"_rest{k}", pattern, "").alias(f"_rest{k + 1}"))
    lengths = [F.length(f"_rest{k}") for k in range(len(CLASSES) + 1)]
    counts = [*(lengths[k] - lengths[k + 1] for k in range(len(CLASSES))), lengths[-1]]
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return out.select(
        "_id", "_lang", "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        lengths[1].cast("bigint").alias("word_chars"),
        counts[6].cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array(*(c.cast("bigint") for c in counts)).alias("_classes"),
    )


def common_words(df: DataFrame, text_col: str, lang_col: str) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Words per language, and the counts of (language, word) from ``COMMON_SHARE`` on."""
    own = df.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), words_of(F.col(text_col)).alias("_words"))
    spark = df.sparkSession
    counted = own.select("_lang", F.explode("_words").alias("_word")).groupBy("_lang", "_word").count()
    scratch = Scratch(spark)
    counted = scratch.keep(counted)
    each = counted.groupBy("_lang").agg(F.sum("count").alias("n"))
    every = each.agg(F.sum("n")).first()[0] or 0
    totals = {r[0]: r[1] for r in each.filter(F.col("n") * LANGUAGES >= every).collect()}
    least = reduce(lambda c, x: c.when(F.col("_lang") == x[0], F.lit(math.ceil(x[1] * COMMON_SHARE))), totals.items(), F.when(F.lit(False), F.lit(0)))
    found = counted.filter((F.col("count") >= least) & F.col("_word").rlike(f"^{COMMON_WORD}$")).collect() if totals else []
    scratch.drop(counted)
    return totals, {(r["_lang"], r["_word"]): r["count"] for r in found}


def _term(p: Column, q: Column) -> Column:
    """Half of one bin's share of the divergence from p and q to their mean, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def class_distance(counts: Column, shares: list[float]) -> Column:
    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return let(F.greatest(total, F.lit(1)).cast("double"), lambda n: F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, x: a + x, (_term(c[k] / n, F.lit(q)) for k, q in enumerate(shares))))))

    return let(counts, of)


def word_runs(words: Column, common: list[str]) -> Column:
    """(k, n) of each common word, by its position k (from 1), in the text."""
    places = F.array(*map(F.lit, common))
    found = F.sort_array(F.transform(F.filter(words, lambda w: w.isin(common)), lambda w: F.array_position(places, w)))

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (s[i - 1] != s[F.least(i, F.size(s) - 1)]))
        return let(ends, lambda e: F.transform(e, lambda x, i: F.struct(s[x - 1].cast("int").alias("k"), (x - F.when(i > 0, e[F.greatest(i - 1, F.lit(0))]).otherwise(0)).alias("n"))))

    return let(found, lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<k:int,n:int>>")).otherwise(runs(s)))


def word_distance(runs: Column, n_words: Column, shares: list[float]) -> Column:
    """``shares``: of the common words, then of all others."""
    table_, other = F.array(*map(F.lit, shares[:-1])), F.lit(shares[-1])
    n = F.greatest(n_words, F.lit(1)).cast("double")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    sums = F.aggregate(runs, zero, lambda a, x: let(F.struct((x["n"] / n).alias("p"), F.element_at(table_, x["k"]).alias("q")), lambda y: F.struct((a["s"] + _term(y["p"], y["q"])).alias("s"), (a["p"] + y["p"]).alias("p"), (a["q"] + y["q"]).alias("q"))))
    # a bin without words of the text adds half its share; the last bin holds all other words
    whole = let(sums, lambda a: a["s"] + F.greatest(F.lit(0.0), F.lit(sum(shares[:-1])) - a["q"]) / 2 + _term(F.greatest(F.lit(0.0), 1 - a["p"]), other))
    return F.sqrt(F.greatest(F.lit(0.0), whole))


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Id, the counts of the base rules, both distances of the nearest language, its name, base_failed and kept."""
    totals, counts = common_words(df, text_col, lang_col)
    weight: dict[str, int] = {}
    for (_, word), n in counts.items():
        weight[word] = weight.get(word, 0) + n
    words = sorted(weight, key=lambda w: (-weight[w], w))
    measured = features(df, id_col, text_col, lang_col)
    measured = measured.withColumn("_runs", word_runs(F.col("_words"), words) if words else F.array().cast("array<struct<k:int,n:int>>")).drop("_words")
    measured = Scratch(df.sparkSession).keep(measured)
    by_class = measured.filter(F.col("_lang").isin(list(totals))).groupBy("_lang").agg(*(F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1))).collect() if totals else []
    class_sums = {r["_lang"]: [r[f"c{k}"] or 0 for k in range(len(CLASSES) + 1)] for r in by_class}
    candidates = []
    for lang in sorted(class_sums):
        shares = [counts.get((lang, w), 0) / totals[lang] for w in words]
        sums = class_sums[lang]
        classes = [c / max(1, sum(sums)) for c in sums]
        candidates.append(F.struct(
            word_distance(F.col("_runs"), F.col("n_words"), [*shares, max(0.0, 1 - sum(shares))]).alias("word_distance"),
            class_distance(F.col("_classes"), classes).alias("class_distance"),
            F.lit(lang).alias("nearest"),
        ))
    none = F.struct(F.lit(None).cast("double").alias("word_distance"), F.lit(None).cast("double").alias("class_distance"), F.lit(None).cast("string").alias("nearest"))
    measured = measured.withColumn("_best", F.array_min(F.array(*candidates)) if candidates else none).select("*", "_best.*")
    n_chars = F.aggregate("_classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    most = F.sqrt(max_word**2 + SAMPLING * (1 / F.least(F.col("n_words"), F.lit(FULL_WORDS)) - 1 / FULL_WORDS))
    diverges = ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > most)) | ((n_chars >= MIN_CHARS) & (F.col("class_distance") > max_class))
    return measured.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~F.coalesce(diverges, F.lit(False))).alias("kept"), "word_distance", "class_distance", "nearest",
    )


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("word_distance", "class_distance")})


def _sql_term(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"(({part(p)}) + ({part(q)})) / 2"


def _sql() -> str:
    k = len(CLASSES)
    rests = ", ".join(f"regexp_replace(r{i}, '{pattern}', '', 'g') AS r{i + 1}" for i, (_, pattern) in enumerate(CLASSES))
    counts = [*(f"length(r{i}) - length(r{i + 1})" for i in range(k)), f"length(r{k})"]
    word_rule = f"n >= {MIN_WORDS} AND wd > sqrt({MAX_WORD_DISTANCE**2} + {SAMPLING} * (1 / least(n, {FULL_WORDS}) - 1 / {FULL_WORDS}))"
    names = [f"k{i}" for i in range(k + 1)]
    total = lambda prefix: "(" + " + ".join(f"{prefix}{n}" for n in names) + ")"
    divergence = " + ".join(_sql_term(f"(d.{n} / greatest({total('d.')}, 1))", f"(c.{n} / greatest({total('c.')}, 1))") for n in names)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS r0, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT *, {rests}, list_filter(string_split(r0, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
d AS (SELECT rid, doc_id, lang, w, len(w) AS n, length(r1) AS word_chars, length(r0) - length(regexp_replace(r0, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  length(r0) AS n_chars, {", ".join(f"{c} AS {n}" for c, n in zip(counts, names))} FROM m),
g AS (SELECT rid, unnest(range(1, n - 6)) AS i, unnest([array_to_string(w[j:j + 7], ' ') FOR j IN range(1, n - 6)]) AS g FROM d WHERE n >= 8),
dup AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k.k) AS n_repeat FROM dup, (SELECT unnest(range(8)) AS k) k GROUP BY rid),
tot AS (SELECT lang, sum(n) AS total FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n) > 0 AND sum(n) * {LANGUAGES} >= (SELECT sum(n) FROM d WHERE lang IS NOT NULL)),
com AS (SELECT lang, word, count(*) AS c, any_value(total) AS total FROM (SELECT lang, unnest(w) AS word FROM d) JOIN tot USING (lang) WHERE regexp_full_match(word, '{COMMON_WORD}')
  GROUP BY 1, 2 HAVING count(*) >= ceil(any_value(total) * {COMMON_SHARE})),
u AS (SELECT DISTINCT word FROM com),
dw AS (SELECT rid, word, count(*) AS k FROM (SELECT rid, unnest(w) AS word FROM d) JOIN u USING (word) GROUP BY 1, 2),
pq AS (SELECT d.rid, tot.lang, coalesce(dw.k, 0) / greatest(d.n, 1) AS p, coalesce(com.c / com.total, 0) AS q FROM d CROSS JOIN tot CROSS JOIN u LEFT JOIN dw ON dw.rid = d.rid AND dw.word = u.word LEFT JOIN com ON com.lang = tot.lang AND com.word = u.word),
ws AS (SELECT rid, lang, sum({_sql_term("p", "q")}) AS s, greatest(0, 1 - sum(p)) AS p, greatest(0, 1 - sum(q)) AS q FROM pq GROUP BY 1, 2),
c AS (SELECT lang, {", ".join(f"sum({n}) AS {n}" for n in names)} FROM d WHERE lang IS NOT NULL GROUP BY lang),
b AS (SELECT d.*, ws.lang AS nearest, sqrt(greatest(0, s + {_sql_term("p", "q")})) AS wd, sqrt(greatest(0, {divergence})) AS cd FROM d JOIN ws USING (rid) JOIN c ON c.lang = ws.lang
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY wd, cd, ws.lang) = 1),
f AS (SELECT b.*, coalesce(cov.n_repeat, 0) AS n_repeat, n < 20 OR 100 * coalesce(cov.n_repeat, 0) > 30 * n AS base_failed FROM b LEFT JOIN cov USING (rid))
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({word_rule} OR n_chars >= {MIN_CHARS} AND cd > {MAX_CLASS_DISTANCE}) AS kept, round(wd, 6) AS word_distance, round(cd, 6) AS class_distance, nearest
FROM f"""


OP6_SQL = _sql()
