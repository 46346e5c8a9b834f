"""Profiles of all values: equal values are tested once, and values that cannot match by their make-up not at all."""

from __future__ import annotations

import random
import re
import unicodedata
from dataclasses import replace
from re import _constants as C
from re import _parser

from pyspark.sql import functions as F

from lychgate.operators import profile
from lychgate.plans.recognizers import EDGE, RECOGNIZERS, Recognizer
from lychgate.sources import router


def made(items, rnd: random.Random, extreme: int | None) -> str:
    """A text that a parsed pattern matches; extreme: the least (0) or the most (1) of everything, open ends up to 70."""
    out = []
    for op, arg in items:
        if op is C.LITERAL:
            out.append(chr(arg))
        elif op is C.IN:
            kinds = [(ord(str(d)),) * 2 for d in range(10)] if arg[0] == (C.CATEGORY, C.CATEGORY_DIGIT) else []
            kinds += [a if o is C.RANGE else (a, a) for o, a in arg if o in (C.RANGE, C.LITERAL)]
            out.append(chr(rnd.randint(*rnd.choice(kinds))))
        elif op is C.MAX_REPEAT:
            least, most, part = arg
            most = min(most, least + 70)
            out += [made(part, rnd, extreme) for _ in range(rnd.randint(least, most) if extreme is None else (least, most)[extreme])]
        elif op is C.SUBPATTERN:
            out.append(made(arg[3], rnd, extreme))
        elif op is C.BRANCH:
            out.append(made(rnd.choice(arg[1]), rnd, extreme))
        else:
            assert op in (C.ASSERT, C.ASSERT_NOT), op
    return "".join(out)


def texts_of(r: Recognizer, n: int = 300) -> list[str]:
    rnd, tree = random.Random(r.name), _parser.parse(re.sub(r"\\p\{\w\}", "", r.pattern.replace(EDGE, "").replace("(?i)", "")))
    return [made(tree, rnd, (None, 0, 1)[k % 3]) for k in range(n)]


def test_make_up_holds_for_every_match():
    for r in RECOGNIZERS:
        for text in texts_of(r):
            kinds = [unicodedata.category(c) for c in text]
            letters, digits = sum(k[0] == "L" for k in kinds), kinds.count("Nd")
            for number, (least, most) in zip((letters, digits, len(text) - letters - digits), r.makeup, strict=True):
                assert least <= number and (most is None or number <= most), (r.name, text)


def test_equal_values_are_tested_once(spark):
    tests = spark.sparkContext.accumulator(0)

    def confirm(text):
        if text is not None:
            tests.add(1)
        return text is not None

    own = Recognizer("own", "OWN", r"[A-Z]{3}-\d+", 0.9, 0.9, (), F.udf(confirm, "boolean"))
    far = "ABC-" + "1" * 80
    df = spark.createDataFrame([("ABC-12", far if k == 7 else None) for k in range(1000)], "a string, b string")
    rows = {r.column: r for r in profile.profile(profile.long_form(df, "t", sample=None), [own], None, None).collect()}
    assert {c: (r.sample_size, r.distinct_count, r.null_count, r.best_ratio) for c, r in rows.items()} == {"a": (1000, 1, 0, 1.0), "b": (1, 1, 999, 1.0)}
    assert tests.value <= 10


def test_counting_first_changes_nothing(spark):
    """The same profiles as by tests of every value, for short and long, whole and broken, plain and other digits and spaces."""
    columns = {r.name: texts_of(r, 60) * 2 for r in RECOGNIZERS}
    columns["wide"] = [t.translate({48 + d: 0xFF10 + d for d in range(10)}) for r in RECOGNIZERS for t in texts_of(r, 8)]
    columns["framed"] = [f"\u3000{t} \x1f" for r in RECOGNIZERS for t in texts_of(r, 8)]
    columns["broken"] = [t[:-1] + "\u00b2" for r in RECOGNIZERS for t in texts_of(r, 8)]
    columns["numbers"] = ["1,000", "+3.50", "\u0663", "-7", " 12 ", "1" * 90]
    columns["dates"] = ["2020-01-02", "1/2/20", "01-02-2020", "\u0661/2/2020", "9999-99-99", None]
    columns["words"] = ["Yes", "n", "TRUE", " f ", "0", "\u3000"]
    columns["short_and_long"] = ["x" * 63, "x" * 64, "x" * 65, "x" * 65, "", None, "\U0001f600" * 64, "\U0001f600" * 65]
    long = router.inline(spark, columns)
    told = lambda recognizers, sample: sorted(map(str, profile.profile(long, recognizers, sample, sample).collect()))
    want = told(RECOGNIZERS, 10**6)
    assert told(RECOGNIZERS, None) == want
    assert told([replace(r, makeup=()) for r in RECOGNIZERS], None) == want
