"""License scans, with DataFrame operations only.

Whole texts are cut into overlapping windows, of a length for each template; MinHash bands of a window's word shingles
retrieve templates; exact shingle containment verifies them.

A band is one minimum. It can only collide where a window holds the very shingle that is the template's minimum, so the bands
are an index of BANDS shingles for each template, which every shingle of every text is looked up in; a window around a hit
collides if none of its other shingles has a smaller hash. No template adds to the plan: they are rows of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SHINGLE = 5
CONTAINED = 0.8
#: A window of L + L / 4 words holds an occurrence of L words whole, so its similarity to the template is at least
#: 0.8 x 0.8 = 0.64 where containment is 0.8: 32 bands of one minimum leave out one in 10^14 occurrences, and one in 10^5
#: at a similarity of 0.3.
BANDS = 32
#: Bytes of the index (some ROW_BYTES for each of BANDS rows a template), and of the templates' shingle sets, up to which they
#: are sent to all executors; larger ones are joined.
HELD_BYTES, ROW_BYTES = 32_000_000, 80

#: Common short license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-deed": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(marks: Column, k: Column | int) -> Column:
    """Hashes of all runs of k (at most SHINGLE) marks of words, by position; none if there are fewer words."""
    n = F.size(marks) - k + 1
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.when(F.lit(j) < k, F.get(marks, i + j)) for j in range(SHINGLE)]))


def once(df: DataFrame, made: Column, name: str, *keep: str) -> DataFrame:
    """df with a column that is made once a row: passed through a generator, no lambda or filter makes it anew."""
    return df.select(*keep, F.explode(F.array(made)).alias(name))


def least_of(hashes: Column, seed: Column) -> Column:
    """The least hash of a set by the hash function of a seed."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, seed)))


def template_index(spark: SparkSession, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(license, k, wide, step, seed, least, shingle), BANDS rows a template, and (license, k, t_shingles), one, of templates (license, body).

    k is the shingle's length, less than SHINGLE only where a template has fewer words; a template without words is refused.
    """
    marked = once(templates, F.transform(words(F.col("body")), lambda w: F.xxhash64(w)), "marks", "license")
    marked = materialise(marked.withColumn("k", F.least(F.size("marks"), F.lit(SHINGLE))), "template-words")
    if bare := [r[0] for r in marked.where("k = 0").select("license").take(5)]:
        raise ValueError(f"templates without a word: {', '.join(map(str, bare))}")
    step = F.greatest(F.floor(F.size("marks") / 4).cast("int"), F.lit(1))
    sized = marked.withColumn("step", step).withColumn("wide", F.size("marks") + step - F.col("k"))
    sets = materialise(once(sized, F.array_distinct(shingles(F.col("marks"), F.col("k"))), "t_shingles", "license", "k", "wide", "step"), "template-sets")
    made = sets.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    made = once(made, least_of(F.col("t_shingles"), F.col("seed")), "least", "license", "k", "wide", "step", "t_shingles", "seed")
    shingle = F.get(F.filter("t_shingles", lambda h: F.xxhash64(h, F.col("seed")) == F.col("least")), F.lit(0))
    index = made.select("license", "k", "wide", "step", "seed", "least", shingle.alias("shingle"))
    return materialise(index, "template-index"), sets.select("license", "k", "t_shingles")


def scan(docs: DataFrame, templates: DataFrame | dict[str, str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and license found: doc_id, license, containment (best window), word (where that window begins), windows.

    templates: (license, body), of any number and length. Texts are compared as lower-case runs of letters and digits. Null, empty
    and shorter texts hold no license; rows that share an id, a null one too, are reported together; other columns are not read;
    an empty table gives an empty result.

    A first pass looks every shingle up in the bands, with nothing of the text beside it; texts with hits are read again, and
    from each the windows that its hits ask for are cut. So a text's length counts once in either pass.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "license string, body string")
    index, sets = template_index(spark, templates)
    sent = lambda df, size: F.broadcast(df) if size <= HELD_BYTES else df
    index_bytes = index.count() * ROW_BYTES
    set_bytes = (sets.agg(F.sum(F.size("t_shingles"))).first()[0] or 0) * 8
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    texts = texts.withColumn("row", F.xxhash64("doc_id", "t"))
    marks = F.transform(words(F.col("t")), lambda w: F.xxhash64(w))
    found = None
    for (k,) in index.select("k").distinct().collect():  # at most SHINGLE lengths, one unless a template is very short
        hashed = lambda df, k, *keep: once(once(df, marks, "marks", *keep), shingles(F.col("marks"), k), "h", *keep)
        placed = hashed(texts, k, "row").select("row", F.posexplode("h").alias("i", "shingle"))
        hits = placed.join(sent(index.where(F.col("k") == k), index_bytes), "shingle")
        starts = F.sequence(F.ceil(F.greatest(F.col("i") - F.col("wide") + 1, F.lit(0)) / F.col("step")).cast("int"), F.floor(F.col("i") / F.col("step")).cast("int"))
        asked = hits.select("row", F.explode(F.transform(starts, lambda s: F.struct((s * F.col("step")).alias("start"), "license", "wide", "seed", "least"))).alias("a"))
        asked = materialise(asked.groupBy("row").agg(F.collect_set("a").alias("asked")), "windows-asked")
        window = lambda a: F.array_distinct(F.slice("h", a["start"] + 1, a["wide"]))
        banded = F.filter("asked", lambda a: least_of(window(a), a["seed"]) == a["least"])
        near = once(hashed(texts.join(asked, "row"), k, "doc_id", "asked"), F.array_distinct(F.transform(banded, lambda a: F.struct(a["license"].alias("license"), a["start"].alias("start"), a["wide"].alias("wide")))), "kept", "doc_id", "h")
        near = near.select("doc_id", F.explode(F.transform("kept", lambda a: F.struct(a["license"].alias("license"), a["start"].alias("start"), window(a).alias("window")))).alias("n")).select("doc_id", "n.*")
        near = near.join(sent(sets.where(F.col("k") == k), set_bytes), "license")
        share = F.size(F.array_intersect("window", "t_shingles")) / F.size("t_shingles")
        part = near.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= contained)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.select("doc_id", F.lit("").alias("license"), F.lit(0).alias("start"), F.lit(0.0).alias("containment")).limit(0)
    best = F.max(F.struct("containment", (-F.col("start")).alias("s")))
    out = found.groupBy("doc_id", "license").agg(best.alias("b"), F.count_distinct("start").alias("windows"))
    return out.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.s")).cast("int").alias("word"), "windows")
