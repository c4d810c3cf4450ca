"""Judges, chart frames and filters on small tables with known results."""

import pytest

from tallyframe.operators import judges, shapes


def test_judge_verdicts(spark):
    rows = [(i, "s", 1 + i % 4, 1 + i % 4, 4, 1 + (i + 1) % 4) for i in range(40)] + [(40, "s", None, 2, 2, 2)]
    long = spark.createDataFrame(rows, "doc int, source string, people int, same int, kind int, odd int")
    got = {r.judge: r for r in judges.validate_judges(long, ["doc", "source"], "people", ["same", "kind", "odd"], [1, 2, 3, 4]).collect()}
    assert got["same"].verdict == "VALIDADO" and got["same"].kappa == 1 and got["same"].n == 40 and got["same"].p_notes == got["same"].p_decisions == 1
    assert got["kind"].verdict == got["odd"].verdict == "NÃO VALIDADO"
    assert (got["kind"].only_judge, got["kind"].only_reference) == (20, 0) and got["kind"].p_decisions == pytest.approx(2 * 0.5**20)


def test_contrasts_of_sources(spark):
    rows = [(i, s, n) for i in range(30) for s, n in (("a", 4), ("b", 2 + i % 2), ("c", 4 if i % 2 else 3))] + [(99, "a", 1)]
    df = spark.createDataFrame(rows, "doc int, source string, note int")
    got = {(r.a, r.b): r for r in judges.source_contrasts(df, "doc", "source", ["a", "b", "c"], "note").collect()}
    assert got["a", "b"].significant and got["a", "b"].effect == 1 and got["a", "b"].n == 30 and got["a", "b"].band == "grande"
    assert all(r.p <= r.p_holm <= 1 for r in got.values()) and got["a", "c"].n == 15


def test_severity_sees_one_strict_rater(spark):
    df = spark.createDataFrame([(i, r, 4 - (r == 3) - i % 2) for i in range(20) for r in (1, 2, 3)], "item int, rater int, note int")
    got = {r.rater: r for r in judges.internal_severity(df, ["item"], "rater", [1, 2, 3], "note").collect()}
    assert got["3"].mean_rank == 3 and got["1"].mean_rank == 1.5 and got["1"].chi2 == pytest.approx(40) and got["1"].p < 1e-6
    assert judges.internal_severity(df.limit(0), ["item"], "rater", [1, 2, 3], "note").count() == 0


def test_process_filter_keys(spark):
    df = spark.createDataFrame([("1", " resp 5 ", "", "20200101", "X"), ("2", "", "RESP", "20200101", "x"), ("3", None, None, None, None), (None, None, None, None, None)], "reg string, proc string, klass string, day string, kind string")
    wanted = lambda *rows: spark.createDataFrame(list(rows), "key string, date string, kind string")
    ids = lambda w: [r.reg for r in shapes.process_filter(df, w, "reg", "proc", "klass", "day", "kind").orderBy("reg").collect()]
    assert ids(wanted(("RESP 5", None, None), ("resp 2", None, None), (None, None, None))) == ["1", "2"]
    assert ids(wanted(("1", "20200101", "x"), ("2", "20200102", None), ("3", "20200101", None))) == ["1"]
    assert ids(wanted(("1", None, None), ("RESP 5", None, None), ("3", None, None))) == ["1", "3"]
    assert ids(wanted()) == []


def test_document_filter_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, None)], "seq int, id string")
    full = spark.createDataFrame([("b", 9), ("b", 9), ("c", 9), ("a", 8)], "id string, seq int")
    wanted = spark.createDataFrame([(1,), (9,), (None,)], "seq int")
    assert sorted(r.id for r in shapes.document_filter(df, wanted, "seq", "id", full).collect()) == ["a", "b", "c"]


def test_exported(spark):
    df = spark.createDataFrame([(1, "x" * 10, '{"a": 12345}'), (2, "x" * 9, '{"a": 12345}'), (3, "x" * 10, '{"a": 12345'), (4, None, '{"a": 12345}')], "id int, t string, j string")
    assert [r.id for r in shapes.already_exported(df, "t", "j", parse=True).collect()] == [1]
    assert [r.id for r in shapes.already_exported(df, "t", "j").collect()] == [1, 3]
