"""The rule ensemble against plain versions: its statistics character by character, its columns as numpy, its score as a sum."""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lychgate.llm import quality

SPACE = "\t\n\x0b\x0c\r "


def plain_statistics(text: str | None) -> list[float]:
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return [0.0] * len(quality.STATISTICS)
    size = lambda s: len(s.encode())
    shown = sum(map(size, words))
    kinds = Counter("upper" if c in string.ascii_uppercase else "digit" if c in string.digits else "point" if c in ".,;:'\"-()?!" else "sign" if c in "#$%&*+/<=>@[\\]^_`{|}~" else "" for w in words for c in w)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    often = lambda xs: max(Counter(xs).values())
    n = len(words)
    return [
        math.log1p(n), shown / n, len(set(words)) / n, often(words) / n, often(lines) / len(lines), len(set(lines)) / len(lines),
        kinds["upper"] / shown, kinds["digit"] / shown, kinds["sign"] / shown, text.count("|") / n, text.count("!!") / n, kinds["point"] / shown,
        math.log1p(max(map(size, words))), math.log1p(n / len(lines)), sum(w[-1] in "#$%&*|" for w in words) / n,
    ]


def test_statistics_equal_a_plain_count(docs, rows):
    more = [None, "", " \n ", "A|B !! !!! x# y$\n\nA|B !! !!! x# y$\n", "Größe 名前 ÀÉ 12,5%", "x" * 3000 + " y", "a\x1cb\x85c d"]
    for text in [*more, *(r.text for r in rows)]:
        assert np.allclose(quality.statistics(text), plain_statistics(text), rtol=1e-12), text
    got = {(r.doc_id, tuple(round(x, 9) for x in r[2:])) for r in quality.with_statistics(docs).collect()}
    assert got == {(r.doc_id, tuple(round(x, 9) for x in plain_statistics(r.text))) for r in rows}


def test_columns_and_score_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((500, len(quality.STATISTICS))), 2)  # rounded, so that bounds are met exactly
    rules = []
    for k in range(60):
        chosen = sorted(rng.choice(len(quality.STATISTICS), rng.integers(1, 5), replace=False).tolist())
        cuts = [(low, low + 0.3) if k % 3 == 0 else (-math.inf, low) if k % 3 == 1 else (low, math.inf) for low in np.round(rng.random(len(chosen)), 2)]
        rules.append(quality.Rule(tuple((c, float(a), float(b)) for c, (a, b) in zip(chosen, cuts, strict=True)), float(rng.normal())))
    model = quality.RuleModel(0.25, tuple(rules))
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(x.tolist())], "k int, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = df.select("k", model.score().alias("score"), F.array(*[r.column() for r in rules]).alias("holds")).orderBy("k").collect()
    holds = np.array([r.holds(x) for r in rules]).T
    assert (np.array([r.holds for r in got]) == holds).all() and 0.02 < holds.mean() < 0.9
    want = 1 / (1 + np.exp(-(0.25 + holds @ np.array([r.weight for r in rules]))))
    assert np.allclose([r.score for r in got], want)


def test_the_fitted_model_scores_as_its_rules_say(spark):
    """Every score of a fitted model, worked out again from its rules; and the rules of a forest are its trees' paths."""
    rng = np.random.default_rng(5)
    rows = [(k, int(k % 2), *(rng.random(len(quality.STATISTICS)) * (1 + k % 2)).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, quality int, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    model = quality.fit(df)
    x = np.array([r[2:] for r in rows])
    total = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    got = [r[0] for r in df.orderBy("doc_id").select(model.score()).collect()]
    assert len(model.rules) > 3 and np.allclose(got, 1 / (1 + np.exp(-total)))
    right = sum((s >= 0.5) == r[1] for s, r in zip(got, rows, strict=True))
    assert right > 0.9 * len(rows)
    assert len({r.bounds for r in model.rules}) == len(model.rules) and all(r.weight for r in model.rules)
