"""Readers, writers, upserts, streams and logs on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, text
from tallyframe.operators import agreement, batches, catalogue, compare, filters, frequentist, messages, splits
from tallyframe.sources import readers, writers
from tallyframe.streaming import events


def test_csv_is_sniffed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ id ;texto\n1;é\n2;b\n", encoding="utf-8")
    assert [(r.id, r.texto) for r in readers.read_dataset(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [(1, "é"), (2, "b")]
    (tmp_path / "b.csv").write_bytes("id,texto\n1,é\n".encode("latin-1"))
    assert readers.read_dataset(spark, str(tmp_path / "b.csv")).first().texto == "é"
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.doc")


def test_json_folder(spark, tmp_path):
    (tmp_path / "observabilidade").mkdir()
    for name, body in (("doc_1.json", '{"a": 1}'), ("doc_2.json", '{"erro": "x"}'), ("doc_3.json", "broken"), ("other.json", "{}"), ("observabilidade/doc_4.json", '{"a": "b "c" d"}')):
        (tmp_path / name).write_text(body)
    (tmp_path / "doc_5.json").write_bytes('{"a": "é"}'.encode("latin-1"))
    got = {r.id: r for r in readers.scan_json_folder(spark, str(tmp_path), r"^doc_(\d+)\.json$").collect()}
    assert set(got) == {"1", "2", "3", "4", "5"} and got["2"].error == "x" and got["3"].json == "{}"
    assert json.loads(got["4"].json) == {"a": 'b "c" d'} and json.loads(got["5"].json) == {"a": "é"}


def test_text_folder_and_zip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("  ")
    assert [r.chave for r in readers.scan_text_folder(spark, str(tmp_path)).collect()] == ["a"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/10.txt", "texto")
        z.writestr("11.txt", "#ERRO nada")
    files = spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))
    assert [(r.seq, r.text) for r in catalogue.zip_texts(files).collect()] == [("10", "texto")]


def test_logs(spark, tmp_path):
    rows = [{"event": "log", "step_global": 1, "train_loss": 2.0}, {"event": "evaluate", "step_global": 1, "eval_loss": 1.0}, {"event": "x", "ram_usada_gb": 3.0}]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    parts = readers.route(readers.scan_log(spark, str(tmp_path / "log.jsonl")))
    assert {k: v.count() for k, v in parts.items()} == {"train": 1, "eval": 1, "eval_global": 0, "stage": 0, "hardware": 1}
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 1, "eval_loss": 1.5}]}))
    train, evaluation = readers.trainer_state(spark, str(tmp_path / "state.json"))
    assert train.first().loss == 2.0 and evaluation.first().eval_loss == 1.5
    (tmp_path / "p.jsonl").write_text('{"prompt":"a","completion":"b"}\n\n{"prompt":"c","completion":"d"}\n')
    assert [(r.id, r.prompt) for r in readers.prompt_completion_lines(spark, str(tmp_path / "p.jsonl")).collect()] == [("linha_001", "a"), ("linha_002", "c")]


def test_upsert_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, batches.SCHEMA)
    batches.upsert_parquet(spark, path, make([("1", "{}", "ok", ""), ("2", "{}", "", "bad")]))
    batches.upsert_parquet(spark, path, make([("2", "{}", "ok", ""), ("3", "{}", None, None)]))
    assert {r.chave: r.resposta for r in spark.read.parquet(path).collect()} == {"1": "ok", "2": "ok", "3": None}
    items = spark.createDataFrame([(str(i),) for i in range(1, 5)], "chave string")
    assert {r.chave for r in batches.pending(items, spark.read.parquet(path)).collect()} == {"3", "4"}
    calls = []

    def infer(df):
        calls.append(df.count())
        return df.select("chave", F.lit("{}").alias("resumo"), F.when(F.col("chave") != "4", "ok").alias("resposta"), F.when(F.col("chave") == "4", "bad").alias("erro"))

    done = batches.run_batches(items, spark.read.parquet(path), infer, rounds=2)
    assert calls == [2, 1, 1] and batches.pending(items, done).count() == 1


def test_stream_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"chave":"1","resumo":"{}","resposta":"x","erro":""}\n{broken\n')
    stream = events.read_log_stream(spark, str(tmp_path / "in"), batches.SCHEMA).filter("chave is not null")
    events.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    assert filters.dataset_filter(df, {"s": "!=a"}).count() == 2
    assert filters.dataset_filter(df, {"n": ">=2", "s": ["b"]}).count() == 1
    with pytest.raises(ValueError):
        filters.dataset_filter(df, {"zz": 1})
    with pytest.warns(UserWarning):
        assert filters.dataset_filter(df, "zz > 1").count() == 3


def test_extractions_and_answers(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, ""), (3, "{bad"), (4, "free text")], "id int, resposta string")
    got = {r.id: r for r in batches.extractions_of(df, "m").collect()}
    assert got["1"].json == '{"a":1}' and got["2"].error == "resposta vazia" and got["3"].error == "JSON inválido" and json.loads(got["4"].json) == {"resposta": "free text"}
    answers = [r.a.erro for r in df.select(batches.process_answer("resposta", "json").alias("a")).collect()]
    assert answers == [None, "empty answer", "invalid JSON", "invalid JSON"]


def test_raters(spark):
    df = spark.createDataFrame([("d1_a", '{"nota": 2.5, "problemas": ["x"]}', ""), ("d_2_b", "", ""), ("d3_a", "zz", ""), ("d4_a", '{"nota": 3}', "boom")], "chave string, resposta string, erro string")
    got = {r.doc: r for r in agreement.normalise_rater(df, 1, "g").collect()}
    assert got["d1"].note == 2 and got["d1"].problems == ["x"] and got["d_2"].reason == "empty" and got["d3"].reason == "not JSON" and got["d4"].failed
    assert agreement.judge_verdict(0.7, 0.2, 0.2, 0) == "VALIDADO" and agreement.judge_verdict(0.5, 0.2, 0.2, 0) == "NÃO VALIDADO"


def test_cache_swaps(spark):
    pairs = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    empty = spark.createDataFrame([], "key string, p double, r double, f1 double")
    score = lambda d: d.select("key", F.lit(0.2).alias("p"), F.lit(0.8).alias("r"), F.lit(0.3).alias("f1"))
    got, fresh = compare.score_with_cache(pairs, empty, score)
    assert fresh.count() == 1 and {(r.p, r.r) for r in got.collect()} == {(0.2, 0.8), (0.8, 0.2)}


def test_run_stats(spark):
    import random

    rng = random.Random(4)
    rows = [(str(i), p, min(1.0, max(0.0, rng.gauss(m, 0.1)))) for i in range(60) for p, m in (("A", 0.5), ("B", 0.52), ("C", 0.9))] + [("x", "A", 0.1)]
    out = frequentist.run_stats(spark.createDataFrame(rows, "doc string, protocol string, value double"))
    assert out["n"] == 60 and out["friedman"]["p"] < 1e-6 and out["groups"]["C"] != out["groups"]["A"]
    assert frequentist.run_stats(spark.createDataFrame(rows[:30], "doc string, protocol string, value double"))["status"] == "insufficient"


def test_dates_and_labels(spark):
    df = spark.createDataFrame([("DJE DATA:05/03/2021", "1614902400000", "2021-03-05T10:00:00", "Ação Cível")], "a string, b string, c string, d string")
    row = df.select(dates.date_of_mirror("a").alias("a"), dates.date_of_fulltext("b").alias("b"), dates.normalise_date("c").alias("c"), text.slug("d").alias("d"), dates.long_date(dates.parse_datetime("c")).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("20210305", "20210305", "20210305", "acao_civel", "05 de março de 2021")


def test_masks_and_formats(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 2, [1, 1, 1, 0])], "ids array<int>, start int, mask array<int>")
    assert df.select(messages.mask_labels("ids", "start", "mask").alias("x")).first().x == [-100, -100, 7, -100]
    assert messages.dataset_format(["prompt", "completion"]) == "prompt_completion"
    own = spark.range(10).select(splits.quantile_note(F.col("id"), 10, [10, 9, 8]).alias("n"))
    assert [r.n for r in own.collect()] == [10] * 4 + [9] * 3 + [8] * 3


def test_writers(spark, tmp_path):
    assert writers.markdown_table([{"a": 1.5, "b": "x"}, {"a": 2.0, "b": None}]) == "| a | b |\n|---|---|\n| 1,5 | x |\n| 2,0 |  |"
    assert writers.validate_columns(spark.range(1), ["id", "resposta"]) == ["missing: resposta"]
    report = writers.SectionedReport("T")
    report.put("s", "one")
    report.put("s", "two")
    assert "two" in report.text() and "one" not in report.text()
    writers.save(spark.range(3), str(tmp_path / "o.csv"))
    assert readers.sniff_separator("a;b;c") == ";"
