"""Tool-call linking and quality rules against plain Python."""

import json
import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from tallyframe.llm import catalog, chat, quality_rules

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connection, differences  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_registered_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], connection(sf_dir)) == []


SCHEMAS = {"t": {"a": ("STRING", True, None, None), "n": ("BIGINT", False, 0, 10)}}


def test_links(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "c0", "t", '{"n":3,"a":"x \\"q\\""}', None), (1, 2, "c2", "t", '{"a":1}', ["c0"]), (1, 4, "c4", "u", "{}", ["c2", "gone"]), (1, 6, "c6", "t", "broken", []), (1, 8, "c8", "t", None, []),
            (2, 0, "d0", "t", '{"a":"x","n":99,"z":1}', ["d1"]), (2, 1, "d1", "t", '{"a":"y"}', ["d2"]), (2, 2, "d2", "t", '{"n":1}', []), (3, 0, "e0", "t", '{"a":"x"}', ["e1"]), (3, 1, "e1", "t", '{"a":"x"}', ["e0"]),
            (4, 0, None, "t", '{"a":"x"}', []), (1, 0, "c0", "t", '{"n":3,"a":"x \\"q\\""}', None), (1, 9, "c0", "t", "{}", []),
        ],
        "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("c0", "b"), ("c0", "a"), ("c2", None), (None, "q"), ("nothing", "r")], "call_id string, content string")
    rows = chat.link_tool_calls(calls, results, SCHEMAS).collect()
    got = {r.call_id: r for r in rows}
    assert sorted(r.errors for r in rows if r.call_id is None) == ["no identifier", "result without a call"]
    assert (got["nothing"].errors, got["nothing"].n_calls, got["nothing"].n_results, got["nothing"].valid) == ("result without a call", 0, 1, False)
    assert len(rows) == 13 and set(got) == {"c0", "c2", "c4", "c6", "c8", "d0", "d1", "d2", "e0", "e1", "nothing", None}
    assert (got["c0"].n_calls, got["c0"].n_results, got["c0"].errors) == (3, 2, "")
    assert got["c0"].json == '{"arguments":{"a":"x \\"q\\"","n":3},"call_id":"c0","conv_id":1,"name":"t","result":"a","step":0,"valid":true}'
    assert got["c2"].errors == "a is not STRING" and json.loads(got["c2"].json)["result"] is None
    assert got["c4"].errors == "unknown tool; dependency is absent"
    assert got["c6"].errors == got["c8"].errors == "arguments are not an object"
    assert [got[k].step for k in ("d2", "d1", "d0")] == [0, 1, 2]
    assert got["d0"].errors == "n is out of range; unknown field" and got["d2"].errors == "a is missing"
    assert got["e0"].step is None and got["e1"].step is None and '"step":null' in got["e0"].json
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def longest_ways(edges, nodes):
    """Level of each node by repeated relaxation; None on or behind a circle."""
    level = {}
    while True:
        free = {v for v in nodes if v not in level and all(d in level for d in edges.get(v, ()))}
        if not free:
            return {v: level.get(v) for v in nodes}
        level |= {v: max((level[d] + 1 for d in edges.get(v, ())), default=0) for v in free}


def test_order_equals_brute_force(spark):
    pick = random.Random(5)
    edges = {f"r{i}": {f"r{pick.randrange(i)}" for _ in range(pick.choice([0, 1, 1, 1, 2, 3]))} for i in range(1, 90)}
    edges |= {f"x{i}": {f"x{i + 1}"} for i in range(70)}  # a chain against the turns
    edges |= {"k0": {"k1"}, "k1": {"k2"}, "k2": {"k0"}, "k3": {"k1"}, "k4": {"k3", "r5"}, "x70": {"r80", "r3"}}
    nodes = sorted(set(edges) | {d for ds in edges.values() for d in ds})
    rows = [(1, i, v, "t", '{"a":"x"}', sorted(edges.get(v, ())), "kept", 0) for i, v in enumerate(nodes)]
    calls = spark.createDataFrame(rows, "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>, errors string, step int")
    results = spark.createDataFrame([("r1", "a", 1)], "call_id string, content string, valid int")
    got = {r.call_id: r.step for r in chat.link_tool_calls(calls, results, SCHEMAS).collect()}
    assert got == longest_ways(edges, nodes)


def test_conversation_rows(spark):
    turns = [(1, 0, "user", "aa", 7), (1, 2, "user", "a", 7), (1, 4, "user", "aaaa", 7), (1, 4, "user", "bbbb", 7), (1, 3, "assistant", "r", 7), (1, 8, "user", None, 7),
             (None, 0, "user", "q", 7), (2, None, "user", "q", 7), (3, 1, "assistant", "lost", 7), (3, None, "assistant", "lost", 7), (4, 0, None, "x", 7)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, call_id int")
    rows = chat.link_tool_calls(*chat.calls_of(df), chat.TOOLS).collect()
    steps = {r.call_id: (r.step, r.n_calls, r.n_results, r.errors) for r in rows if r.call_id}
    assert steps["call_1_2"][0] == 1 and steps["call_1_4"][:2] == (0, 2) and steps["call_3_0"] == (None, 0, 1, "result without a call")
    assert "dependency is absent" in steps["call_1_8"][3]
    assert sorted(r.errors for r in rows if r.call_id is None) == ["no identifier", "no identifier", "result without a call"]


def repeated(words, n=8):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)})


TEXTS = [
    None, "", "  \n ", "one", "a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h j x y z", "w " * 40, "x#y $ | <a> é ü\nsame line\nsame line\n\n \nother",
    " ".join(f"the {i} of and" for i in range(80)), "\x0b\x0c a\tb\r\nc ", "z " * 3 + " ".join(map(str, range(200))) + " " + " ".join(map(str, range(40))),
]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality_rules.assess(df).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i].n_words == len(w) and got[i].word_chars == sum(map(len, w))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].n_repeat_words == repeated(w), i
        assert got[i].base_failed == (len(w) < 20 or 100 * repeated(w) > 30 * len(w))
        assert not (got[i].kept and got[i].base_failed)
    assert quality_rules.assess(df.limit(0)).count() == 0


def js(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) / 2 for x in (a, b) if x > 0)
    return math.sqrt(max(0.0, total))


def classes_of(text):
    rest, out = text, []
    for _, pattern in quality_rules.CLASSES:
        short = re.sub(pattern, "", rest)
        out.append(len(rest) - len(short))
        rest = short
    return [*out, len(rest)]


def test_distances_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    got = {r.doc_id: r for r in quality_rules.assess(docs).collect()}
    total, count, classes = Counter(), Counter(), {}
    for _, t, lang in rows:
        for w in re.findall(r"[^\x20\x09-\x0D]+", t):
            total[lang] += 1
            count[lang, w] += 1
        classes[lang] = [a + b for a, b in zip(classes.get(lang, [0] * 9), classes_of(t))]
    common = sorted({w for (lang, w), n in count.items() if n >= math.ceil(total[lang] * quality_rules.COMMON_SHARE) and all(unicodedata.category(c)[0] in "LM" for c in w)})
    for i, t, _ in rows[:120]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = Counter(words)
        n, chars = max(1, len(words)), classes_of(t)
        best = []
        for lang in classes:
            q = [count[lang, w] / total[lang] if count[lang, w] >= math.ceil(total[lang] * quality_rules.COMMON_SHARE) else 0 for w in common]
            p = [own[w] / n for w in common]
            word = js([*p, 1 - sum(p)], [*q, 1 - sum(q)])
            best.append((word, js([c / max(1, sum(chars)) for c in chars], [c / sum(classes[lang]) for c in classes[lang]]), lang))
        word, char, lang = min(best)
        assert abs(got[i].word_distance - word) < 1e-6 and abs(got[i].class_distance - char) < 1e-6 and got[i].nearest == lang


def test_word_rule_judges_short_texts(spark):
    prose = "the of and to in a is that it was for on are as with his they at be this"
    junk = " ".join(f"qz{a}{b}" for a in "abcdefgh" for b in "stuvwxyz")
    df = spark.createDataFrame([(i, " ".join(f"{w} n{i}x{k}" for k, w in enumerate(prose.split() * 4)), "en") for i in range(40)] + [(90, junk, "en"), (91, " ".join(junk.split()[:40]), "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.assess(df, max_class=1.0).collect()}
    assert got[90].n_words == 64 and not got[90].base_failed and not got[90].kept
    assert got[91].kept and all(got[i].kept for i in range(40))


def test_common_words_of_any_script(spark):
    prose = "и в не на я что он с как это по но они мы из у за то же вы так"
    junk = " ".join(f"щъ{a}{b}" for a in "абвгдежз" for b in "стуфхцчш")
    rows = [(i, " ".join(f"{w} н{i}х{k}" for k, w in enumerate(prose.split() * 4)), "ru") for i in range(40)] + [(90, junk, "ru")]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_class=1.0).collect()}
    assert not got[90].base_failed and not got[90].kept and all(got[i].kept for i in range(40))


def test_no_language_known(spark):
    df = spark.createDataFrame([(1, "word " * 3 + " ".join(f"w{i}" for i in range(60)), None)], "doc_id bigint, text string, lang string")
    row = quality_rules.assess(df).first()
    assert row.kept and row.nearest is None and row.word_distance is None
