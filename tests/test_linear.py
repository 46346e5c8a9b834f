"""Texts of any length: segments change nothing, and time grows with the text."""

from __future__ import annotations

import random
import time
from dataclasses import replace

from pyspark.sql import functions as F

from lychgate.functions.arrays import CHUNK, bound, chunks, cut, running
from lychgate.operators import detect, policy, redact
from lychgate.plans.recognizers import RECOGNIZERS

PARTS = [
    "mail jo@example.com", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "nric S1234567D", "tel 020 7946 0958", "+65 9123 4567", "10.1.2.3", "born 3 May 1999", "born 1/2/2001",
    "passport K1234567", "123-45-6789", "tfn 123 456 782", "plain words", "Größe,", "名前、", "\n", "; ", "ABCD EF12", "12", "34 56", "x" * 300, "A123456(3)", "medicare 2123 45670 1",
]


def crowded(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "-", ". "]) for _ in range(n))


def test_segments_change_nothing(spark):
    rng = random.Random(8)
    texts = [crowded(rng, n) for n in (1, 5, 40, 200, 400, 900, 900, 900)] + [None, "", "no digit", "1" * 9000, "a@b.co " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8).cache()
    whole = tuple(replace(r, breaks=False) for r in RECOGNIZERS)
    found = {r.id: r.findings for r in detect.scan(df).collect()}
    assert found == {r.id: r.findings for r in detect.scan(df, recognizers=whole).collect()}
    assert sum(len(f) for f in found.values()) > 1000
    for k, text in enumerate(texts):
        assert all(text[f.start : f.end] == f.text for f in found[k])
    assert df.select(F.max(F.size(F.transform(detect.segments(F.col("text"), False), lambda s: s["at"])))).first()[0] > 5


def plain_redacted(text: str, applied: list) -> str:
    out, at = [], 0
    for a in applied:
        out += [text[at : a.start], a.replacement]
        at = a.end
    return "".join([*out, text[at:]])


def test_redaction_of_long_texts(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(crowded(rng, 700),), ("z" * 3000,), ("z" * 3000 + " jo@example.com",)], "text string")
    for r in redact.redact(detect.scan(df)).collect():
        assert r.redacted == plain_redacted(r.text, r.applied)


PLACES = ((0, CHUNK), (CHUNK - 1, CHUNK + 1), (5, 3 * CHUNK + 7), (4, 4))


def test_folds_and_slices(spark):
    numbers = [list(range(n)) for n in (0, 1, 127, 128, 129, 1000)]
    df = spark.createDataFrame([(x, "名𝄞a" * (len(x) * 3 + 1)) for x in numbers], "x array<int>, t string")
    sums = running(F.col("x"), F.lit(0), lambda s, v: s + v, lambda s, v: s, "int")
    places = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PLACES])
    slices = bound(chunks(F.col("t")), lambda c: F.transform(places, lambda p: cut(c, p["a"], p["b"])))
    for r in df.select("x", "t", sums.alias("sums"), slices.alias("slices")).collect():
        assert r.sums == [sum(r.x[:k]) for k in range(len(r.x))]
        assert r.slices == [r.t[a:b] for a, b in PLACES]


def test_time_grows_with_the_text(spark):
    """Four times the findings in one text cost at most five times as much, and 40,000 of them seconds; with words between them and without."""

    def took(n: int, each: str) -> float:
        df = spark.createDataFrame([(" ".join(each.format(k % 10_000) for k in range(n)),)], "text string")
        began = time.time()
        got = policy.decide(redact.redact(detect.scan(df))).select(F.size("findings"), F.length("redacted")).first()
        assert got[0] == n
        return time.time() - began

    for each in ("write to u{}@example.com today", "+65 9123 {:04d}"):
        took(100, each)
        small = min(took(10_000, each) for _ in range(2))
        large = took(40_000, each)
        assert large < 5 * small and large < 60, (each, small, large)
