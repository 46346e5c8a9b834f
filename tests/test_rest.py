from __future__ import annotations

import json
import sqlite3

import pytest

from lychgate.operators import audit, detect, engines, policy
from lychgate.sources import router
from lychgate.streaming import scan as streams


def events(n):
    return [("scan_text", f"d{k}", {"findings": {"EMAIL_ADDRESS": k}}) for k in range(n)]


def test_audit_chain(spark, tmp_path):
    log = audit.AuditLog(str(tmp_path / "a" / "log.jsonl"))
    assert log.append(events(3)) == 3
    head = log.verify()
    row = audit.check(spark, str(log.path)).first()
    assert (row.records, row.changed, row.unlinked, row.heads, row.head) == (3, 0, 0, 1, head)
    exported = log.export()
    again = audit.AuditLog.restore(str(tmp_path / "b.jsonl"), exported)
    assert again.verify() == head
    with pytest.raises(FileExistsError):
        audit.AuditLog.restore(str(tmp_path / "b.jsonl"), exported)
    with pytest.raises(ValueError):
        audit.AuditLog.restore(str(tmp_path / "c.jsonl"), "\n".join(exported.splitlines()[:-1]))
    bare = audit.AuditLog.restore(str(tmp_path / "d.jsonl"), "\n".join(exported.splitlines()[1:]))
    with pytest.raises(ValueError):
        bare.verify()
    assert bare.reanchor() == head == bare.verify()
    with pytest.raises(ValueError):
        log.append([("x", "y", {"hash": "1"})])
    log.path.write_text(log.path.read_text().replace('"EMAIL_ADDRESS": 1', '"EMAIL_ADDRESS": 9'))
    assert audit.check(spark, str(log.path)).first().changed == 1
    with pytest.raises(ValueError):
        log.verify()


def test_audit_events_hold_no_values(spark):
    df = policy.decide(detect.scan(spark.createDataFrame([(1, "j@x.com")], "doc_id int, text string")))
    rows = audit.events(df).collect()
    assert [r.kind for r in rows] == ["scan_text", "egress_decision"]
    assert all("j@x.com" not in r.payload for r in rows)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('x {"is_pii": true, "confidence": 2, "rationale": "r"} y', (True, 1.0, "r")),
        ('{"is_pii": "no"}', (False, 0.5, "")),
        ('{"is_pii": "maybe"}', None),
        ('{"is_pii": 1, "confidence": "junk"}', (True, 0.5, "")),
        ("{ broken", None),
        ("", None),
    ],
)
def test_verdicts(raw, want):
    assert engines.verdict(raw) == want


def test_entities_are_verbatim():
    raw = json.dumps({"entities": [{"type": "PERSON_NAME", "text": "Ann"}, {"type": "PERSON_NAME", "text": "Bob"}, {"type": "CITY", "text": "x"}, 3]})
    assert [(e["start"], e["end"]) for e in engines.entities(raw, "Ann and Ann", "m")] == [(0, 3), (8, 11)]


def test_engines(spark):
    from pyspark.sql import functions as F

    def ask():
        return lambda text: json.dumps({"entities": [{"type": "PERSON_NAME", "text": "Ann"}]})

    def failing():
        def away(*_):
            raise OSError("away")

        return away

    df = spark.createDataFrame([("Ann is in",), (None,)], "text string")
    got = detect.scan(df.withColumn("m", engines.ask_for_entities(F.col("text"), ask, "m")), model_col="m", engines=["m"]).collect()
    assert [[f.text for f in r.findings] for r in got] == [["Ann"], []]
    assert df.select(F.size(engines.ask_for_entities(F.col("text"), failing, "m"))).first()[0] == 0
    review = spark.createDataFrame([("t", "c", "s")], "table string, column string, summary string")
    assert engines.ask_for_verdicts(review, failing).count() == 0


def test_engines_read_whole_texts(spark):
    """Names late in a long text and across the end of a window are found; a window that fails costs only its own."""
    from pyspark.sql import functions as F

    def make():
        def ask(text):
            if "fail" in text:
                raise OSError
            assert len(text) <= 6000
            return json.dumps({"entities": [{"type": "PERSON_NAME", "text": n} for n in ("Ann Lee", "Bob Ray", "Cy Dow") if n in text]})

        return ask

    text = "fail " + "x" * 5992 + "Ann Lee" + "y" * 9000 + "Bob Ray" + "z" * 4000 + "Cy Dow"
    df = spark.createDataFrame([(text,), ("",), ("Ann Lee",)], "text string")
    got = [[text[f.start : f.end] for f in r.m] for r in df.select(engines.ask_for_entities(F.col("text"), make, "m").alias("m")).collect()]
    assert got[0] == ["Ann Lee", "Bob Ray", "Cy Dow"] and not got[1] and len(got[2]) == 1
    assert all(len(engines.windows("a" * n)) == k for n, k in ((1, 1), (6000, 1), (6001, 2), (11500, 2), (11501, 3)))


def test_sources(spark, tmp_path):
    (tmp_path / "people.csv").write_text('﻿name,note\nAnn,"a ""b""\nc"\nBob\n', encoding="utf-8")
    (name, df), = router.open_source(spark, str(tmp_path / "people.csv")).items()
    assert name == "people" and df.columns == ["name", "note"]
    assert [tuple(r) for r in df.collect()] == [("Ann", 'a "b"\nc'), ("Bob", None)]
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "odd name" (id INTEGER, v TEXT)')
        db.executemany('INSERT INTO "odd name" VALUES (?, ?)', [(1, "a"), (2, None)])
    (name, df), = router.open_source(spark, path).items()
    assert name == "odd name" and sorted(map(tuple, df.collect())) == [("1", "a"), ("2", None)]
    with pytest.raises(ValueError):
        router.open_source(spark, "x.xyz")


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(v,) for v in ["b", None, "a", "c", "a"]], "v string")
    a, b = ([r.value for r in router.sample(d, "v", 4).collect()] for d in (df, df.repartition(3)))
    assert a == b and None not in a
    assert router.sample(df, "v", 0).count() == 0
    with pytest.raises(ValueError):
        router.sample(df, "v", -1)


@pytest.mark.parametrize(
    ("call", "address"),
    [
        (router.postgres_options, "postgres://u:p@h/db"),
        (router.postgres_options, "postgres://u:p@h/db?sslmode=verify-full&sslrootcert="),
        (router.mysql_options, "mysql://h/db?x=1"),
        (router.mysql_options, "mysql://h/db?ssl_verify_cert=maybe"),
        (router.bigquery_dataset, "bigquery://my-project:443/d"),
        (router.bigquery_dataset, "bigquery://my-project/d?x"),
    ],
)
def test_refused_addresses(call, address):
    with pytest.raises(ValueError):
        call(address)


def test_addresses():
    assert router.safe_address("mysql://u:secret@h/db?x=secret") == "mysql://h/db (withheld)"
    assert router.safe_address("x:u:secret@h") == "x: (withheld)"
    assert router.safe_address("postgres://h:5432/db") == "postgres://h:5432/db" and router.safe_address("a/b.xyz") == "a/b.xyz"
    for address in ("u:secret@h", "http://u:secret@[h", "mysql://h:port/secret", "s3://secret@b/k#secret", ""):
        assert "secret" not in router.safe_address(address) and "(withheld)" in router.safe_address(address)
    assert router.mysql_options("mysql://u:@h/db", {router.MYSQL_PASSWORD: "no"})["password"] == ""
    assert router.mysql_options("mysql://u@h/db", {router.MYSQL_PASSWORD: " s "})["password"] == " s "
    with pytest.raises(ValueError):
        router.mysql_options("mysql://u@h/db", {router.MYSQL_PASSWORD: ""})
    assert router.bigquery_dataset("bigquery://my-project/d") == ("my-project", "d")


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "to j@x.com"), (2, "SSN 123-45-6789"), (3, "hi")], "doc_id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    out = streams.guarded_stream(spark, str(tmp_path / "in"), df.schema)
    q = streams.write_with_audit(out, str(tmp_path / "out"), str(tmp_path / "cp"), lambda part, n: seen.append(part.count()), ["doc_id"])
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.released) for r in rows] == [(1, "to <EMAIL_ADDRESS>"), (3, "hi")]
    assert sum(seen) == 3


def test_entry_stands_without_the_training_data_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lychgate", tmp_path / "lychgate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'egress_summary' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_batches_are_recorded_once(spark, tmp_path):
    df = policy.decide(detect.scan(spark.createDataFrame([(1, "to j@x.com"), (2, "SSN 123-45-6789"), (3, None)], "doc_id int, text string")))
    log = audit.AuditLog(str(tmp_path / "log.jsonl"))
    record = streams.audited(log, "mail")
    for n in (0, 1, 0, 1):
        record(df, n)
    rows = [json.loads(x) for x in log.path.read_text().splitlines()]
    assert [(r["kind"], r["source_id"]) for r in rows] == [(k, f"mail#{n}") for n in (0, 1) for k in ("scan_text", "egress_decision")]
    assert rows[0]["findings"] == {"EMAIL_ADDRESS": 1, "US_SSN": 1} and rows[1]["action"] == "BLOCK" and rows[1]["actions"] == {"ALLOW": 1, "REDACT": 1, "BLOCK": 1}
    assert audit.summary(df.limit(0), "none")[1][2]["action"] == "ALLOW"


def test_corpus_quality(spark):
    from lychgate.operators import evaluate

    schema = "case_id int, text string, expected array<struct<label: string, text: string>>"
    mail = ("EMAIL_ADDRESS", "j@x.com")
    cases = spark.createDataFrame([(1, "j@x.com j@x.com", [mail, mail, mail]), (2, "k@x.com", [mail]), (3, "hi", []), (4, None, None)], schema)
    said = evaluate.scanned(cases)
    rows = {r.case_id: r for r in evaluate.compared(cases, said).collect()}
    assert [(rows[k].tp, rows[k].fp, rows[k].fn) for k in (1, 2, 3, 4)] == [(2, 0, 1), (0, 1, 1), (0, 0, 0), (0, 0, 0)]
    assert [tuple(x) for x in rows[1].missed] == [mail] and [x.text for x in rows[2].spurious] == ["k@x.com"]
    q = evaluate.text_quality(cases, said).first()
    assert (q.cases, q.positive, q.precision, q.recall) == (4, 2, 2 / 3, 0.5)
    only = lambda test: evaluate.text_quality(cases.where(test), said.join(cases.where(test), "case_id", "left_semi")).first()
    assert (only("case_id > 2").precision, only("case_id > 2").recall) == (1.0, 0.0)
    assert (only("case_id = 1").precision, only("case_id = 1").recall) == (0.0, 2 / 3)
    assert (only("false").cases, only("false").precision, only("false").recall) == (0, 0.0, 0.0)
    assert evaluate.block_recall(cases, said).first().recall == 0.0
    assert evaluate.block_recall(cases, said, ["EMAIL_ADDRESS"]).first().recall == 0.5
    columns = spark.createDataFrame([("email", "PII_DIRECT"), ("gone", "NON_PII")], "column string, category string")
    got = evaluate.measure({"en": cases, "ja": cases.where("case_id = 3")}, columns, columns.where("column = 'email'"), ["EMAIL_ADDRESS"])
    assert got == {"precision_en": 2 / 3, "recall_en": 0.5, "precision_ja": 1.0, "recall_ja": 0.0, "columns": 0.5, "block_recall": 0.5}
    assert len(evaluate.gate(got)) == 5
    assert [s.split(":")[0] for _, _, s in evaluate.path_coverage(ner="m")] == ["MEASURED", "UNMEASURED", "inactive", "inactive"]
