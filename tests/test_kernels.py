"""Similarity, JSON text forms, comparison semantics, distributions."""

import itertools
import math
import random

import numpy as np
import pytest

from tallyframe.functions import distributions, jsontext, similarity
from tallyframe.operators import bayes, compare, filters, frequentist, splits


def scores(true, pred, fields):
    return {(f, m, s): v for f, m, s, v in compare.compare_values(true, pred, compare.MetricPlan(fields))}


def test_indel_ratio():
    assert similarity.indel_ratio("casa", "caza") == 0.75
    assert similarity.indel_ratio("", "") == 1 and similarity.indel_ratio("a", "") == 0

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == brute(a, b)


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert similarity.porter_stem(word) == stem


def test_rouge():
    assert similarity.rouge("the cat sat", "the cat sat", "rouge2") == (1, 1, 1)
    p, r, f = similarity.rouge("the cat sat on the mat", "the cat", "rouge1")
    assert (p, round(r, 4)) == (1, 0.3333)
    assert similarity.rouge("a b c d", "a c d b", "rouge")[2] == 0.75
    assert similarity.rouge("", "a", "rouge1") == (0, 0, 0)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.random((n, m))
        got = similarity.assignment(c)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(r, q)) for r in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
        assert len(got) == k and abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def test_alignment():
    pred, true = similarity.align(["banana split", "apple pie"], ["apple pie", "banana split", "cherry"], str)
    assert pred == ["apple pie", "banana split", None] and true == ["apple pie", "banana split", "cherry"]
    assert similarity.align([], ["a"], str) == ([None], ["a"])
    assert similarity.align(["zzz"], ["aaa", "bbb"], str)[0] == ["zzz", None]


def test_paths_and_structure():
    value = {"a": {"b": 1, "c": {"d": []}}, "e": [{"f": 1}]}
    assert list(jsontext.paths(value)) == ["a", "a.b", "a.c", "a.c.d", "e"]
    assert jsontext.path_get({"a": [{"b": 1}, {"b": None}, {"b": [2, 3]}]}, "a.b") == [1, 2, 3]
    assert jsontext.count_keys(value) == 6
    got = jsontext.structure(jsontext.paths({"a": 1, "b": 2, "x": 3}), jsontext.paths({"a": 1, "b": 2, "c": 3, "d": 4}))
    assert (got["P"], got["R"], got["missing"], got["extra"]) == (0.667, 0.5, ["c", "d"], ["x"])


def test_repair():
    assert jsontext.json_of_message('text ```json\n{"a": "b "c" d"}\n``` end') == {"a": 'b "c" d'}
    assert jsontext.json_of_message("no object") == {} and jsontext.json_of_message("{broken") == {}
    assert jsontext.safe_object('```json\n{"a": 1}\n```') == {"a": 1} and jsontext.safe_object("[1]") == {}
    assert jsontext.resolve_embedded(['{"a": "[1]"}', "{x"]) == [{"a": [1]}, "{x"]


def test_text_forms():
    value = {"a": True, "b": [1, 2, 3], "c": {"d": None, "e": []}, "f": [{"g": "x"}, None]}
    assert jsontext.natural(value).startswith("a é verdadeiro.\n\nb contém 1, 2 e 3.\n\nc d é null. c e está vazio.")
    assert "Item 2 está vazio." in jsontext.natural(value)
    assert jsontext.linear({"a": 1, "b": ["x", "y"], "c": {"d": 2}}) == "a: 1. b: x; y. c: d: 2."
    assert jsontext.markdown({"a": 1, "b": ["x", {"c": 2}]}).startswith("# a")
    assert jsontext.value_text("Ação  “X”\nY", "rouge") == 'ação "x" y'
    assert jsontext.value_text({"b": 1, "a": 2}, "rouge") == "a é 2.\n\nb é 1."
    assert jsontext.value_text({"erro": "x"}, "rouge") == "" and jsontext.value_text(True, "rouge") == "true"


def test_compare_rules():
    same = scores({"a": "x y", "b": [1]}, {"a": "x y", "b": [1]}, {"rouge2": ["(global)"], "levenshtein": ["a", "b"]})
    assert same["a", "levenshtein", "SIM"] == 1 and same["(global)", "rouge2", "F1"] == 1 and same["(estrutura)", "rouge1", "F1"] == 1
    assert scores({"erro": "x"}, {"a": 1}, {}) == {}
    bad = scores({"a": "x"}, {"erro": "x"}, {})
    assert bad["(global)", "rouge", "F1"] == 0 and bad["(estrutura)", "rouge1", "F1"] == 0
    empty = scores({"a": None, "b": "", "c": "x"}, {"b": [], "c": None}, {"levenshtein": ["a", "b", "c", "d"]})
    assert [empty[f, "levenshtein", "SIM"] for f in "abcd"] == [1, 1, 0, 1]
    missing = scores({"a": 1, "b": 2, "c": 3, "d": 4}, {"a": 1, "b": 2, "x": 3}, {"levenshtein": ["(global)"]})
    assert 0.6 <= missing["(estrutura)", "rouge1", "P"] <= 0.7 and 0.4 <= missing["(estrutura)", "rouge1", "R"] <= 0.6
    items = scores({"l": [{"a": "one thing"}, {"a": "other words"}]}, {"l": [{"a": "other words"}, {"a": "one thing"}]}, {"levenshtein": ["l"]})
    assert items["l", "levenshtein", "SIM"] == 1
    with pytest.raises(ValueError):
        compare.MetricPlan({"nope": ["a"]})
    assert compare.plan_of_yaml({"rouge_l": "a", "bertscore": ["b"]}, quick=True).metrics_of("b") == ["rouge"]


def test_distributions():
    assert abs(distributions.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(distributions.chi2_sf(20, 10) - 0.029252688076961) < 1e-9
    assert abs(distributions.normal_quantile(0.975) - 1.959963984540054) < 1e-9
    assert abs(distributions.student_cdf(2.0, 5) - 0.949030260585071) < 1e-9
    assert abs(distributions.studentized_range_sf(3.314, 3) - 0.05) < 1e-3
    assert distributions.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    w, p = distributions.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.005 and abs(p - 0.0067) < 0.001
    assert math.isnan(distributions.shapiro([1, 1, 1])[0])


def test_holm_and_letters():
    assert frequentist.holm([0.01, 0.04, 0.03, math.nan]) == [0.04, 0.09, 0.09, 1.0]
    groups = frequentist.letter_groups({"a": 1.0, "b": 2.0, "c": 3.0}, {("a", "b"): 0.5, ("a", "c"): 0.001, ("b", "c"): 0.5})
    assert groups == {"a": {1}, "b": {1, 2}, "c": {2}} and frequentist.share_group(groups["a"], groups["b"])


def test_bayes_invariants():
    r = bayes.sign_test(30, 5, 10)
    assert abs(r.left + r.rope + r.right - 1) < 1e-9 and r.relation() == "x_melhor" and r.mirror().relation() == "y_melhor"
    t = bayes.correlated_t(50, 0.0, 0.01, 0.05)
    assert t.rope > 0.8 and abs(t.left - t.right) < 1e-9
    s = bayes.signed_rank(np.full(30, 0.2), 0.05, 200)
    assert s.left > 0.95


def test_splits_arithmetic():
    assert splits.ratios({"treino": 70, "teste": None, "validacao": None}) == pytest.approx({"treino": 0.7, "teste": 0.15, "validacao": 0.15})
    assert splits.note_edges(5, 2) == [0, 2, 4]
    assert filters.select_protocols(["M1", "beta", "x"], ["m1", "m2"], {"m2": "Beta"}) == (["m1", "m2"], ["x"])


def test_windows():
    assert similarity.windows(10, 4, 0.25) == [(0, 4), (3, 7), (6, 10)]
    assert similarity.windows(3, 4, 0.5) == [(0, 3)] and similarity.windows(0, 4, 0.5) == []


def test_windowed_scores():
    score = lambda p, t: similarity._prf(len(set(p) & set(t)), len(set(p)), len(set(t)))
    assert similarity.windowed_score(list("abc"), list("abc"), score, 8, 0.5) == (1, 1, 1)
    long = [str(i) for i in range(20)]
    assert similarity.windowed_score(long, long, score, 8, 0.5) == (1, 1, 1)
    p, r, _ = similarity.windowed_score(long, long[:8], score, 8, 0.5)
    assert 0 < p < 1 and 0 < r < 1


def test_projection():
    value = {"a": {"b": 1, "c": 2}, "d": [{"e": 1}, {"e": 2}], "f": None}
    assert jsontext.project(value, ["a.b", "d.e", "zz"]) == {"a": {"b": 1}, "d": {"e": [1, 2]}}
    assert jsontext.project(value, []) == value and jsontext.project({"erro": 1, "a": 2}, ["a"]) == {"erro": 1, "a": 2}


def test_configuration():
    from tallyframe.operators import config

    assert config.proportion("0.7, 0.2") == [0.7, 0.2, 0] and config.proportion([{"treino": 1}, {"teste": 2}]) == [1, 0, 2]
    assert config.parse_filter('{"a": ">1"}') == {"a": ">1"} and config.parse_filter("") is None
    with pytest.raises(ValueError):
        config.parse_filter("a > 1")
    stages = config.build_stages([{"alias": "x", "arquivo": "f"}, {"proporcao": "0.5,0.5"}])
    assert [s.alias for s in stages] == ["x", "etapa_2"] and stages[1].share == [0.5, 0.5, 0]
    with pytest.raises(ValueError):
        config.unique_labels(["a", "b", "a"])
    assert config.config_hash({"a": 1, "b": 2}) == config.config_hash({"b": 2, "a": 1})


def test_whole_table_queries_reach_every_row(spark, sf_dir):
    from tallyframe.plans import registry

    ids = lambda name, column: {r[0] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(column).collect()}
    keys, spans = ids("orders", "o_orderkey"), ids("customer", "c_custkey")
    got = lambda name, column: {r[0] for r in registry.QUERIES[name](spark, sf_dir).select(column).collect()}
    assert got("join_range", "o_orderkey") == {k for k in keys if k // 40 in spans}
    assert got("join_span_lookup", "step") == ids("events", "event_id")
    assert got("search_top_k", "item_id") == ids("benchmark", "item_id")


def test_bayes_methods(spark):
    import random

    from tallyframe.operators import bayes

    rng = random.Random(4)
    df = spark.createDataFrame([(f"d{i}", p, rng.random() + shift) for i in range(30) for p, shift in (("a", 0.5), ("b", 0.0))], "doc string, protocol string, value double")
    for method in ("sinais", "postos", "t"):
        first, second = bayes.matrix(df, 0.01, method)
        assert first["metodo"] == method and abs(first["p_direita"] - second["p_esquerda"]) < 1e-12
        assert max(first["p_esquerda"], first["p_direita"]) > 0.9
    with pytest.raises(ValueError):
        bayes.matrix(df, 0.01, "other")


def test_bounded_tables_are_never_cut(spark):
    from tallyframe.operators import frequentist

    assert len(frequentist.bounded(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        frequentist.bounded(spark.range(6), 5)
