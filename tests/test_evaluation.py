"""The gate of a release over the labelled cases in evaluation/, in both languages."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from lychgate import cli, scan_sql
from lychgate.operators import evaluate
from lychgate.plans.recognizers import RECOGNIZERS

FOLDER = Path(__file__).resolve().parent.parent / "evaluation"


def test_the_gate_holds(spark):
    measured, short = evaluate.run(spark, str(FOLDER))
    assert short == [] and set(measured) == set(evaluate.BARS), (measured, short)


def test_the_gate_can_fail(spark, tmp_path, capsys):
    shutil.copytree(FOLDER, tmp_path / "cases")
    lines = [json.loads(x) for x in (FOLDER / "ja.jsonl").read_text(encoding="utf-8").splitlines()]
    for case in lines[:6]:
        case["text"] = case["text"].replace("1", "一")
    (tmp_path / "cases" / "ja.jsonl").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines), encoding="utf-8")
    (tmp_path / "cases" / "columns.jsonl").write_text((FOLDER / "columns.jsonl").read_text().replace('"NON_PII"', '"SENSITIVE"').replace("PII_QUASI", "NON_PII"))
    assert cli.main(["evaluate", str(tmp_path / "cases")]) == 4
    short = json.loads(capsys.readouterr().out.splitlines()[-1])["short"]
    assert {s.split(":")[0] for s in short} >= {"recall_ja", "columns"} and not any("_en" in s for s in short)


def test_columns_are_those_of_their_table(spark):
    expected = spark.createDataFrame([("a", "x", "NON_PII"), ("b", "x", "PII_DIRECT")], "table string, column string, category string")
    assert evaluate.column_accuracy(expected, expected).first().accuracy == 1.0
    bare = spark.createDataFrame([("x", "NON_PII")], "column string, category string")
    row = evaluate.column_accuracy(bare, expected).first()
    assert (row.expected, row.correct) == (1, 0)
    assert evaluate.column_accuracy(bare.limit(0), expected).first().accuracy == 0.0


def test_the_constants_of_the_sql_are_those_of_the_recognizers():
    assert {r.name: (r.entity, r.plain, r.boosted, r.needs_context, r.validator is not None, r.context) for r in RECOGNIZERS} == scan_sql.FACTS
    assert [r.name for r in RECOGNIZERS] == list(scan_sql.FACTS)
