"""Findings that overlap: what each recognizer finds alone, and what is kept pack by pack."""

from __future__ import annotations

from lychgate import catalog
from lychgate.operators import detect
from lychgate.plans.recognizers import JURISDICTIONS, select


def test_counts_are_of_each_recognizer_alone(spark, tmp_path):
    text = "write to jo@10.0.0.1.example.com"
    spark.createDataFrame([(1, text, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {r.entity: r.n for r in catalog.QUERIES["entity_counts_by_lang"](spark, str(tmp_path)).collect()}
    assert counts == {"EMAIL_ADDRESS": 1, "IP_ADDRESS": 1}
    assert catalog.QUERIES["egress_decision"](spark, str(tmp_path)).first().findings_considered == 2
    assert catalog.QUERIES["eval_precision_recall"](spark, str(tmp_path)).first()[:3] == (1, 0, 1)


def test_packs_look_for_each_pattern_once(spark, tmp_path):
    df = spark.range(300).select(catalog.F.col("id").alias("o_orderkey")).select("o_orderkey", catalog.crowd_text().alias("text"))
    got = {(r.o_orderkey, r.f.pack): r.f.findings for r in detect.each(detect.scan_packs(df, JURISDICTIONS), "packs", "o_orderkey").collect()}
    for pack in JURISDICTIONS:
        for r in detect.scan(df, recognizers=select([pack])).collect():
            assert got[r.o_orderkey, pack] == r.findings
    df.select("o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert catalog.QUERIES["scan_packs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
