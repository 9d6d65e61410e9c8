"""The pipeline on a small table, stage by stage."""

import corpus_pipeline
from lexstream.llm import common

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    scratch = common.Scratch(spark, "test")
    docs = common.table(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in common.table(spark, SF, "labels").collect()}
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.put(stage(spark, docs, SF))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns if k < len(corpus_pipeline.STAGES) - 1 else set(columns) < set(docs.columns)
    first, near, clean, mixed, last = seen.values()
    good = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in first for i in good) >= 0.97 * len(good)
    assert sum(i in first for i, r in labels.items() if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in labels.values())
    assert len(near) < len(first) and set(clean) <= set(near) and set(mixed) <= set(clean) and set(last) == set(mixed)
    assert any(clean[i]["text"] != near[i]["text"] for i in clean) or len(clean) < len(near)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_empty(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
