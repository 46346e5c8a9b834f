from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lychgate.operators import classify, detect, evaluate, images, policy, profile, redact
from lychgate.plans.recognizers import RECOGNIZERS, select

CASES = [
    ("mail me at jo@example.com", [("EMAIL_ADDRESS", "jo@example.com")]),
    ("card 4111 1111 1111 1111 ok", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("card 4111 1111 1111 1112", []),
    ("pay to GB82 WEST 1234 5698 7654 32.", [("IBAN", "GB82 WEST 1234 5698 7654 32")]),
    ("NRIC S1234567D", [("SG_NRIC", "S1234567D")]),
    ("HKID A123456(3)", [("HK_HKID", "A123456(3)")]),
    ("tfn 123 456 782", [("AU_TFN", "123 456 782")]),
    ("no context 123 456 782", []),
    ("server 10.1.2.3 and 10.1.2.300", [("IP_ADDRESS", "10.1.2.3")]),
    ("call +65 9123 4567", [("PHONE_NUMBER", "+65 9123 4567")]),
    ("tel 020 7946 0958", [("PHONE_NUMBER", "020 7946 0958")]),
    ("passport K1234567", [("PASSPORT", "K1234567")]),
    ("ref K1234567", []),
    ("born 29/02/2000", [("DATE_OF_BIRTH", "29/02/2000")]),
    ("born 29/02/2001", []),
    ("SSN 123-45-6789", [("US_SSN", "123-45-6789")]),
    ("旅券 K1234567", [("PASSPORT", "K1234567")]),
    ("nothing here", []),
    ("", []),
    (None, None),
]


def test_scan(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "id int, text string")
    rows = detect.scan(df).orderBy("id").collect()
    for r, (text, want) in zip(rows, CASES, strict=True):
        assert [(f.entity_type, f.text) for f in r.findings] == (want or []), text
        for f in r.findings:
            assert text[f.start : f.end] == f.text


def oracle_spans(r, text):
    """The same shape by Python's own engine."""
    p = r.pattern.replace(r"\p{L}\p{N}", r"\w")
    return [(m.start(), m.end()) for m in re.finditer(p, text)]


def test_spans_match_python(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "4111 1111", "10.1.1.1", "+65", "é", "名", "😀", " ", "\n", "-", "(", ")", "12", "345", "6789", "S1234567D", ".", "x_", "GB82", "WEST", "1/2/2020", "3 May 1999", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", *[detect.spans(F.col("text"), r.regex).alias(r.name) for r in RECOGNIZERS]).orderBy("id").collect()
    for row, text in zip(got, texts, strict=True):
        for r in RECOGNIZERS:
            assert [(s.start, s.end) for s in row[r.name]] == oracle_spans(r, text), (r.name, text)


def test_resolution_prefers_validated_then_confidence(spark):
    text = "card 4111111111111111 mail x@y.com"
    row = detect.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert [(f.entity_type, f.validated) for f in row.findings] == [("CREDIT_CARD", True), ("EMAIL_ADDRESS", False)]
    assert row.findings[0].confidence == 0.99


def test_model_findings_are_capped_and_bounded(spark):
    m = "array<struct<entity_type: string, start: int, end: int, confidence: double, recognizer: string>>"
    df = spark.createDataFrame([("Ann was here", [("PERSON_NAME", 0, 3, 0.99, "m"), ("PERSON_NAME", 5, 99, 0.9, "m"), ("PERSON_NAME", 4, 4, 0.9, "m")])], f"text string, m {m}")
    row = detect.scan(df, model_col="m", engines=["m", "m"]).first()
    assert [(f.text, f.confidence) for f in row.findings] == [("Ann", 0.85)]
    assert row.engines == ["regex", "m"]


@pytest.mark.parametrize(
    ("strategy", "want"),
    [("tag", "to <EMAIL_ADDRESS> now"), ("mask", "to ***.com now"), ("remove", "to  now")],
)
def test_redaction(spark, strategy, want):
    df = redact.redact(detect.scan(spark.createDataFrame([("to j@x.com now",), (None,)], "text string")), strategies={}, default=strategy)
    assert [r.redacted for r in df.collect()] == [want, None]


def test_redacted_tags_scan_clean(spark):
    df = redact.redact(detect.scan(spark.createDataFrame([(t,) for t, _ in CASES if t], "text string")), strategies={})
    again = detect.scan(df.select(F.col("redacted").alias("text")))
    assert again.where(F.size("findings") > 0).count() == 0


def test_hash_joins(spark):
    df = redact.redact(detect.scan(spark.createDataFrame([("a j@x.com",), ("b j@x.com",)], "text string")), strategies={}, default="hash")
    a, b = (r.redacted[2:] for r in df.collect())
    assert a == b and re.fullmatch(r"<EMAIL_ADDRESS#[0-9a-f]{12}>", a)


def test_policy(spark):
    df = spark.createDataFrame([("SSN 123-45-6789",), ("j@x.com",), ("tel 020 7946 0958",), ("hi",)], "text string")
    rows = policy.decide(detect.scan(df)).collect()
    assert [r.action for r in rows] == ["BLOCK", "REDACT", "REDACT", "ALLOW"]
    assert [r.reasons[0].severity for r in rows] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    few = policy.decide(detect.scan(df), policy.Policy(block_at_or_above=2)).first()
    assert few.action == "ALLOW" and few.reasons[0].severity == "HIGH" and few.findings_considered == 1


def test_jurisdictions():
    assert {r.jurisdiction for r in select(["sg "])} == {"GLOBAL", "SG"}
    for bad in ([], ["XX"]):
        with pytest.raises(ValueError):
            select(bad)


COLUMNS = {
    "email": [f"p{k}@x.com" for k in range(40)],
    "gender": ["F", "M"] * 20,
    "salary_sgd": [str(1000 + k) for k in range(40)],
    "fullName": [f"Name {k}" for k in range(40)],
    "product_code": ["A1"] * 40,
    "date_of_birth": [f"{1 + k % 28:02d}/01/1990" for k in range(40)],
    "opened": [f"2020-01-{1 + k % 28:02d}" for k in range(40)],
    "flag": ["0", "1"] * 20,
    "blank": [None, " ", "　"],
}
WANT = {"email": "PII_DIRECT", "gender": "PII_QUASI", "salary_sgd": "SENSITIVE", "fullName": "PII_DIRECT", "product_code": "NON_PII", "date_of_birth": "PII_QUASI", "opened": "NON_PII", "flag": "NON_PII", "blank": "NON_PII"}


def test_registered_profiles_see_values_beyond_the_sample(spark, tmp_path):
    """Personal data after the first 500 values, and text after the first 200 numbers."""
    from lychgate import catalog

    rows = [(k, str(k) if k < 600 else f"user{k}@example.com") for k in range(2000)]
    spark.createDataFrame(rows, "k long, v string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([("x",)], "w string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([("x",)], "w string").write.parquet(str(tmp_path / "region.parquet"))
    (v,) = catalog.profiles(spark, str(tmp_path), "customer").where("column = 'v'").collect()
    assert (v.inferred_type, v.sample_size, v.best_entity, v.best_ratio) == ("text", 2000, "EMAIL_ADDRESS", 0.7)
    c = {(r.table, r.column): r for r in catalog.classify.classify(catalog.profiles(spark, str(tmp_path), "customer")).collect()}["customer", "v"]
    assert c.entity_type == "EMAIL_ADDRESS"
    fails = {r.table: (r.fails, r.escalates) for r in catalog.fail_on_pii(spark, str(tmp_path)).collect()}
    assert True in fails["customer"] and True not in fails["nation"]


def test_profile_and_classify(spark):
    from lychgate.sources import router

    p = profile.profile(router.inline(spark, COLUMNS))
    by = {r.column: r for r in p.collect()}
    assert {c: r.inferred_type for c, r in by.items()} == {"email": "text", "gender": "text", "salary_sgd": "numeric", "fullName": "text", "product_code": "text", "date_of_birth": "date", "opened": "date", "flag": "boolean", "blank": "empty"}
    assert by["blank"].null_count == 3 and by["blank"].avg_length == 0.0
    assert by["email"].best_entity == "EMAIL_ADDRESS" and by["email"].best_ratio == 1.0
    c = classify.classify(p)
    assert {r.column: r.category for r in c.collect()} == WANT
    want = spark.createDataFrame(list(WANT.items()), "column string, category string")
    assert evaluate.column_accuracy(want, c).first().accuracy == 1.0
    assert classify.roll_up(c).first().fails


def test_name_rules(spark):
    names = ["customerName", "filename", "NRICNumber", "ip_address", "client_ip", "homePhone2", "zip"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", classify.name_rule(classify.normalise(F.col("n"))).alias("r"))
    assert [(r.r and (r.r.entity, r.r.category)) for r in df.collect()] == [("PERSON_NAME", "PII_DIRECT"), None, ("SG_NRIC", "PII_DIRECT"), ("ADDRESS", "PII_DIRECT"), ("IP_ADDRESS", "PII_QUASI"), None, (None, "PII_QUASI")]


def test_verdict_moves_only_the_band(spark):
    from lychgate.sources import router

    p = profile.profile(router.inline(spark, {"full_name": [f"N {k}" for k in range(40)], "email": COLUMNS["email"]}))
    v = spark.createDataFrame([("inline", "full_name", False, 1.0, "no"), ("inline", "email", False, 1.0, "no")], "table string, column string, is_pii boolean, confidence double, rationale string")
    rows = {r.column: r for r in classify.classify(p, v).collect()}
    assert rows["full_name"].llm_adjudicated and rows["full_name"].score == 0.35
    assert not rows["email"].llm_adjudicated and rows["email"].category == "PII_DIRECT"
    assert "N 1" not in classify.for_review(classify.classify(p)).first().summary


def test_images(spark):
    words = [("4111", 0), ("1111", 10), ("1111", 20), ("1111", 30), ("end", 40)]
    df = spark.createDataFrame([(1, [(w, x, 0, 8, 5, 90.0) for w, x in words])], f"id int, words {images.WORDS}")
    assert [b.left for b in images.scan_images(df).first().boxes] == [0, 10, 20, 30]


def test_precision_recall(spark):
    schema = "case_id int, label string, text string"
    e = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (2, "B", "y")], schema)
    p = spark.createDataFrame([(1, "A", "x"), (2, "B", "z")], schema)
    r = evaluate.precision_recall(e, p).first()
    assert (r.tp, r.fp, r.fn, r.precision) == (1, 1, 2, 0.5)
    none = evaluate.precision_recall(e.limit(0), p.limit(0)).first()
    assert (none.precision, none.recall) == (0.0, 0.0)
    assert evaluate.gate(dict.fromkeys(evaluate.BARS, 1.0)) == []
    assert evaluate.gate({}) and evaluate.gate(dict.fromkeys(evaluate.BARS, 0.1))
