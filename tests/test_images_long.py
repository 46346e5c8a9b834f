"""Boxes of long texts: each word is placed once, whatever the number of findings."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lychgate.operators import images
from lychgate.plans.recognizers import RECOGNIZERS


def test_boxes_of_a_long_text(spark):
    words = [f"w{k}@x.org,u{k}@y.org" if k % 50 == 7 else f"word{k}" for k in range(10_000)]
    rows = [(1, words), (2, ["none"] * 10_000), (3, ["a@b.co"]), (4, [])]
    word = lambda w, i: F.struct(w.alias("text"), i.cast("int").alias("left"), F.lit(0).alias("top"), F.lit(8).alias("width"), F.lit(5).alias("height"), F.lit(90.0).alias("confidence"))
    df = spark.createDataFrame(rows, "id int, w array<string>").select("id", F.transform("w", word).alias("words"))
    began = time.time()
    got = {r.id: [b.left for b in r.boxes] for r in images.scan_images(df, recognizers=[r for r in RECOGNIZERS if r.name == "email"]).collect()}
    assert got == {1: [k for k in range(10_000) if k % 50 == 7], 2: [], 3: [0], 4: []}
    assert time.time() - began < 40
