"""The trail of any size: what it finds, what it costs, and what a batch that failed leaves."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from lychgate.operators import audit
from lychgate.operators.trail import Trail, roots, with_leaves
from lychgate.streaming import scan as streams


def made(spark, n: int, start: int = 0):
    return spark.range(start, start + n).select(F.lit("scan_text").alias("kind"), F.concat(F.lit("d"), "id").alias("source_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('{"n": '), F.col("id") % 3, F.lit("}"))).alias("payload"))


@pytest.fixture
def trail(spark, tmp_path):
    t = Trail(str(tmp_path / "events"), audit.AuditLog(str(tmp_path / "log.jsonl")))
    for n in range(3):
        assert t.append(made(spark, 400, 1000 * n), "mail", n)
    return t


def test_roots_do_not_depend_on_how_events_are_split(spark):
    rows = made(spark, 300).unionByName(made(spark, 300))
    a, b = (roots(with_leaves(df, F.lit("x#0"))).collect() for df in (rows, rows.repartition(7).orderBy(F.desc("source_id"))))
    assert a == b and a[0].events == 600
    assert roots(with_leaves(made(spark, 300), F.lit("x#0"))).first().root != a[0].root != roots(with_leaves(rows, F.lit("x#1"))).first().root


def test_whole_trails_and_repeated_batches(spark, trail):
    rows = trail.check(spark).collect()
    assert len(rows) == 3 and all(r.whole and r.recorded == r.found == 400 and r.changed == 0 for r in rows)
    assert trail.append(made(spark, 400, 2000), "mail", 2) is None and len(trail.log._lines()) == 3
    assert trail.append(made(spark, 0), "empty", 0) and trail.check(spark).where("stream = 'empty'").first().whole
    assert trail.log.verify() == trail.log._end()[0]


@pytest.mark.parametrize("what", ["changed", "lost", "moved", "added", "forged"])
def test_what_was_done_to_events_is_found(spark, trail, tmp_path, what):
    place = trail.place("mail", 1)
    table = spark.read.parquet(place)
    other = spark.read.parquet(trail.place("mail", 2)).limit(1)
    did = {
        "changed": table.withColumn("payload", F.when(F.col("source_id") == "d1007", "{}").otherwise(F.col("payload"))),
        "lost": table.where("source_id <> 'd1007'"),
        "moved": table.where("source_id <> 'd1007'").unionByName(other.withColumn("batch", F.lit("mail#1"))),
        "added": table.unionByName(table.limit(1)),
        "forged": with_leaves(table.withColumn("payload", F.lit("{}")), F.lit("mail#1")),
    }[what]
    did.select(table.columns).write.parquet(str(tmp_path / "new"))
    shutil.rmtree(place)
    shutil.copytree(tmp_path / "new", place)
    rows = {r.number: r for r in trail.check(spark).collect()}
    assert not rows[1].whole and rows[0].whole and rows[2].whole
    assert (rows[1].found, rows[1].changed) == {"changed": (400, 1), "lost": (399, 0), "moved": (400, 1), "added": (401, 0), "forged": (400, 0)}[what]


def test_proofs_hold_without_the_table(spark, trail):
    event = {"kind": "scan_text", "source_id": "d1007", "payload": '{"n": 2}'}
    proof = trail.proof(spark, "mail", 1, event)
    recorded = {r.number: r.root for r in trail.recorded(spark).collect()}
    assert proof.holds(event) and proof.root == recorded[1] and len(proof.levels) == 3
    assert not proof.holds({**event, "payload": '{"n": 1}'}) and not type(proof)("mail#0", proof.root, proof.levels).holds(event)
    assert not type(proof)(proof.batch, recorded[0], proof.levels).holds(event)
    assert trail.proof(spark, "mail", 1, {"kind": "scan_text", "source_id": "d1005", "payload": None}).holds({"kind": "scan_text", "source_id": "d1005", "payload": None})
    with pytest.raises(ValueError):
        trail.proof(spark, "mail", 0, event)


def test_appending_reads_the_end_alone(tmp_path, monkeypatch):
    log = audit.AuditLog(str(tmp_path / "log.jsonl"))
    log.append([("scan_text", f"d{k}", {"note": "x" * 9000}) for k in range(50)], batch="s#4")
    monkeypatch.setattr(audit, "head_of", lambda lines: pytest.fail("the chain was read"))
    assert log.append([("scan_text", "more", {})], batch="s#5") == 1
    assert log.append([("scan_text", "again", {})], batch="s#5") == log.append([("scan_text", "old", {})], batch="s#2") == 0
    assert log.append([("scan_text", "single", {})], batch="once") == 1 and log.append([("scan_text", "single", {})], batch="once") == 0
    monkeypatch.undo()
    head = log.verify()
    assert json.loads(log._lines()[-1])["hash"] == head and len(log._lines()) == 52
    log.path.write_text("".join(x + "\n" for x in log._lines()[:-1]))
    with pytest.raises(ValueError):
        log.append([("scan_text", "late", {})])


def test_old_anchors_are_taken(tmp_path):
    log = audit.AuditLog(str(tmp_path / "log.jsonl"))
    log.append([("scan_text", "a", {})], batch="s#0")
    log.head_path.write_text(log.verify() + "\n")
    assert log.append([("scan_text", "a", {})], batch="s#0") == 0 and log.append([("scan_text", "b", {})], batch="s#1") == 1
    assert log.verify()


def test_a_failed_batch_leaves_one_copy(spark, tmp_path, monkeypatch):
    """It fails after its rows and events were written and before its root was recorded, and is run again."""
    df = spark.createDataFrame([(k, f"to u{k}@x.com") for k in range(20)], "doc_id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    trail = Trail(str(tmp_path / "events"), audit.AuditLog(str(tmp_path / "log.jsonl")))
    run = lambda: streams.write_committed(streams.guarded_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"), trail, "mail", ["doc_id"])
    with monkeypatch.context() as m:
        m.setattr(audit.AuditLog, "append", lambda *_, **__: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(Exception, match="gone"):
            run().awaitTermination(120)
    assert (tmp_path / "out").exists() and not trail.log.path.exists()
    run().awaitTermination(120)
    run().awaitTermination(120)
    rows = streams.committed(spark, str(tmp_path / "out"), trail, "mail")
    assert sorted(r.doc_id for r in rows.collect()) == list(range(20)) and rows.where("released LIKE '%@%'").count() == 0
    checked = trail.check(spark).collect()
    assert [(r.stream, r.number, r.found, r.whole) for r in checked] == [("mail", 0, 60, True)]
    assert audit.check(spark, str(trail.log.path)).first().records == 1
    rows.select("doc_id", "released", "action").limit(3).write.parquet(str(tmp_path / "out" / "number=7"))
    assert streams.committed(spark, str(tmp_path / "out"), trail, "mail").count() == 20
