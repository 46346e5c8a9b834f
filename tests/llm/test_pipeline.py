from __future__ import annotations

from collections import Counter

import corpus_pipeline
from lychgate.llm.queries import ORACLES, QUERIES


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mixing", "packing"]
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert set(ORACLES) < set(QUERIES)


def test_stages(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        nxt = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert sorted(nxt.columns) == sorted(docs.columns), name
        ids, before = (Counter(r.doc_id for r in x.select("doc_id").collect()) for x in (nxt, now))
        assert set(ids) <= set(before), name
        if name in ("quality", "near_duplicates"):
            assert all(ids[i] <= before[i] for i in ids), name
        if name == "passages":
            assert ids == before
        now = nxt
    assert now.count() > 0


def test_near_duplicates_stage_keeps_one_of_each_group(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    texts = Counter((r.text or "").lower() for r in kept if (r.text or "").split())
    assert max(texts.values()) == 1
    assert {r.doc_id for r in kept} >= {0, 1, 2, 5}
