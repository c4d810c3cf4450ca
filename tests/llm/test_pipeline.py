"""The corpus pipeline, stage by stage, on the small tables."""

import corpus_pipeline

from tallyframe.llm.common import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, n, quality = Scratch(spark), docs.count(), {}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, sf_dir))
        assert out.schema.names == docs.schema.names and 0 < out.count() <= n, name
        n, docs = out.count(), out
        quality[name] = {r.doc_id for r in out.select("doc_id").collect()}
    good = {i for i, q in labels.items() if q == 1}
    bad = {i for i, q in labels.items() if q == 0}
    assert len(good & quality["quality"]) > 0.95 * len(good)
    assert len(bad & quality["quality"]) < 0.35 * len(bad)
    assert quality["near-duplicates"] <= quality["lines"] <= quality["quality"] <= quality["language"]
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == quality["near-duplicates"]


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns[0] == "doc_id" and rows.count() > 0
