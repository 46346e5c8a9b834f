from __future__ import annotations

from collections import Counter

import pytest

from lychgate import catalog
from lychgate.operators import detect, engines
from lychgate.plans.recognizers import RECOGNIZERS

DATA = "/root/testdata/sf0.001"


def times_split(df, pattern: str) -> int:
    """How often the optimised plan splits texts by a pattern: once for each scan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(f", {pattern}, -1")


@pytest.mark.parametrize("name", ["scan_findings", "scan_email", "egress_summary", "entity_counts_by_lang", "redact_mask", "ocr_box_overlap", "egress_reasons"])
def test_texts_are_scanned_once(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    email = next(r for r in RECOGNIZERS if r.name == "email").regex
    assert times_split(catalog.QUERIES[name](spark, DATA), email) == 1


def test_expressions_are_made_once(spark):
    df = spark.createDataFrame([("a@b.co",)], "text string")
    detect.scan(df)
    before = detect.expression.cache_info().hits
    assert detect.scan(df).select("findings").first().findings[0].text == "a@b.co"
    assert detect.expression.cache_info().hits == before + 1


def test_only_the_first_object_of_an_answer_counts():
    assert engines.first_object('so: {"a": {"b": 1}} {"c": 2}') == {"a": {"b": 1}}
    assert engines.first_object('{"is_pii": tru, "x": {"is_pii": true}}') is None
    assert engines.verdict('{broken {"is_pii": true, "confidence": 1}}') is None
    assert engines.entities('{"entities": [{"type": "PERSON_NAME", "text": "Al"}, {"type": "ADDRESS", "text": "Al"}, {"type": "X", "text": "Al"}]}', "Al, Al", "m") == [
        {"entity_type": "PERSON_NAME", "start": a, "end": a + 2, "confidence": 0.7, "recognizer": "m"} for a in (0, 4)
    ]
    assert "never a value" not in engines.column_prompt("x") and "x" in engines.column_prompt("x")
    assert all(k in engines.entity_prompt("words {}") for k in (*engines.MODEL_LABELS, "words {}"))


def test_queries_match_their_sql(spark):
    """The queries with new SQL, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "orders", "nation", "region", "customer", "supplier", "part", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return Counter(tuple("~" if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))

    for name in ("scan_findings", "egress_summary", "egress_reasons", "redact_by_label", "scan_crowded", "scan_date_of_birth", "scan_iban", "classify_made", "classify_signals", "profile_made", "fail_on_pii"):
        assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df()), name


@pytest.mark.parametrize("name", ["classify_columns", "profile_made"])
def test_profiles_scan_a_table_once(spark, name):
    """One scan of each table, and no text of a column in a shuffle: what goes there are counts and hashes."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    df = catalog.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    files = [f for f in ("region", "nation", "customer", "supplier", "part", "orders", "events") if f"{f}.parquet" in plan]
    assert plan.count("FileScan parquet") == len(files) == (7 if name == "classify_columns" else 1)
    assert "Join" not in plan
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all(", v#" not in line for line in keys)
