"""Findings in a text column: match, validate, confirm by context, keep the best of what overlaps.

Everything is row-local and built in: a scan needs no shuffle and no Python, in batch and in streams alike. A text is cut into
segments where no match can go on, findings are made and resolved in each, and what overlaps is resolved cluster by
cluster, so that the work is linear in a text and its findings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, chunks, cut, running
from ..plans.recognizers import RECOGNIZERS, Recognizer, select

FINDING = "struct<entity_type: string, start: int, end: int, text: string, confidence: double, recognizer: string, validated: boolean, context_boosted: boolean, ord: int>"
FINDINGS = f"array<{FINDING}>"
SPAN = "struct<start: int, end: int, text: string>"
CONTEXT_CHARS = 48
LEAST_CONFIDENCE = 0.35
MODEL_CAP = 0.85
#: Characters of a segment at least, but for the last one.
SEGMENT = 2000
#: Where a segment may end: behind a character that no pattern takes or looks for, or behind a space between a small letter and
#: something other than a digit (patterns with spaces have digits or capitals before, or a digit after).
BREAK = r"[\n\r\t,;!?\"'<>|=*#&^~:$\[\]{}\u3001\u3002\uff0c\uff01\uff1f]|(?<=[a-z]) (?![\p{Nd}])"


def none() -> Column:
    return F.array().cast(FINDINGS)


def spans(text: Column, regex: str, test: Callable[[Column], Column] | None = None) -> Column:
    """All matches (that pass a test of their texts) with their half-open code-point spans: matches and the gaps between them alternate. Gaps are
    only looked for where there is such a match."""
    none_ = F.array().cast(f"array<{SPAN}>")

    def place(gap: Column, hit: Column, at: Column) -> Column:
        start = at + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text"))

    def placed(hits: Column) -> Column:
        gaps = F.split(text, regex, -1)
        several = lambda g: running(F.arrays_zip(F.slice(g, 1, F.size(hits)).alias("gap"), hits.alias("hit")), F.lit(0), lambda at, p: at + F.length(p["gap"]) + F.length(p["hit"]), lambda at, p: place(p["gap"], p["hit"], at), SPAN)
        return bound(gaps, lambda g: F.when(F.size(hits) == 1, F.array(place(F.get(g, F.lit(0)), F.get(hits, F.lit(0)), F.lit(0)))).otherwise(several(g)))

    def passing(hits: Column) -> Column:
        made = placed(hits)
        if test:
            made = bound(F.transform(hits, test), lambda good: F.when(F.exists(good, lambda g: g), F.filter(placed(hits), lambda s, i: F.get(good, i))).otherwise(none_))
        return F.when(F.size(hits) > 0, made).otherwise(none_)

    return bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), passing)


def segments(text: Column, whole: bool) -> Column:
    """Segments of a text: at (where it begins), text, and, of its text with CONTEXT_CHARS before and after, wide, in chunks, and low, in small letters;
    digits: whether it has one. whole: one segment."""

    def segment(at: Column, part: Column, before: Column | None = None, after: Column | None = None) -> Column:
        lead = F.lit(0) if before is None else F.length(before)
        made = lambda wide: F.struct(at.alias("at"), part.alias("text"), lead.alias("lead"), chunks(wide).alias("wide"), F.lower(wide).alias("low"), part.rlike(r"(?U)\d").alias("digits"))
        return made(part) if before is None else bound(F.concat(before, part, after), made)

    def inside(all_: Column, s: Column, i: Column) -> Column:
        before = F.coalesce(F.right(F.get(all_, i - 1)["text"], F.lit(CONTEXT_CHARS)), F.lit(""))
        after = F.coalesce(F.left(F.get(all_, i + 1)["text"], F.lit(CONTEXT_CHARS)), F.lit(""))
        return segment(s["at"], s["text"], before, after)

    one = F.array(segment(F.lit(0), text))
    if whole:
        return one
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{{SEGMENT}}}.*?(?:{BREAK}|\z)|.+"), F.lit(0))
    placed = running(parts, F.lit(0), lambda at, part: at + F.length(part), lambda at, part: F.struct(at.alias("at"), part.alias("text")), "struct<at: int, text: string>")
    return F.when(F.length(text) <= SEGMENT, one).otherwise(bound(placed, lambda p: F.transform(p, lambda s, i: inside(p, s, i))))


def near_words(segment: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is in a segment or CONTEXT_CHARS around it: where it isn't, it is near no span. A sigma's small form depends on what follows it."""
    return segment["low"].rlike(re.sub("[σς]", "[σς]", "|".join(map(re.escape, words))))


def has_context(segment: Column, start: Column, end: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is near a span of a segment."""
    low = F.greatest(segment["lead"] + start - CONTEXT_CHARS, F.lit(0))
    window = F.lower(cut(segment["wide"], low, segment["lead"] + end + CONTEXT_CHARS))
    # one flat pattern keeps the expression shallow
    return window.rlike("|".join(map(re.escape, words)))


def recognize(segment: Column, r: Recognizer, order: int) -> Column:
    """What one recognizer finds in a segment, at its places in the segment."""
    text = segment["text"]

    def finding(s: Column) -> Column:
        boosted = has_context(segment, s["start"], s["end"], r.context)
        made = lambda confidence, up: F.struct(
            F.lit(r.entity).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(confidence).alias("confidence"),
            F.lit(f"regex:{r.name}").alias("recognizer"), F.lit(r.validator is not None).alias("validated"), F.lit(up).alias("context_boosted"), F.lit(order).alias("ord"),
        )
        plain = F.lit(None).cast(FINDING) if r.needs_context else made(r.plain, False)
        return F.when(boosted, made(r.boosted, True)).otherwise(plain)

    kept = F.filter(F.transform(spans(text, r.regex, r.validator), finding), lambda f: f.isNotNull())
    likely = segment["digits"] if r.guard == r"\d" else text.rlike("(?U)" + r.guard)
    if r.needs_context:
        likely = likely & near_words(segment, r.context)
    return F.when(likely, kept).otherwise(none())


def moved(f: Column, by: Column) -> Column:
    """A finding of a segment at its place in the text."""
    return F.struct(*[((f[n] + by) if n in ("start", "end") else f[n]).alias(n) for n in ("entity_type", "start", "end", "text", "confidence", "recognizer", "validated", "context_boosted", "ord")])


def from_model(text: Column, model: Column) -> Column:
    """Findings of a model: spans out of bounds go, text comes from the source, confidence is capped, nothing counts as validated."""
    good = F.filter(model, lambda f: (f["start"] >= 0) & (f["end"] <= F.length(text)) & (f["start"] < f["end"]))
    made = F.transform(
        good,
        lambda f, i: F.struct(
            f["entity_type"].alias("entity_type"), f["start"].cast("int").alias("start"), f["end"].cast("int").alias("end"), text.substr(f["start"].cast("int") + 1, (f["end"] - f["start"]).cast("int")).alias("text"),
            F.least(f["confidence"].cast("double"), F.lit(MODEL_CAP)).alias("confidence"), f["recognizer"].alias("recognizer"), F.lit(False).alias("validated"), F.lit(False).alias("context_boosted"), (i + 1000).cast("int").alias("ord"),
        ),
    )
    return F.coalesce(made, none())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy(findings: Column) -> Column:
    """Of findings that hang together: validated ones first, then by confidence, length, place and order, each kept unless it overlaps one that is."""
    keyed = F.transform(findings, lambda f: F.struct((~f["validated"]).alias("a"), (-f["confidence"]).alias("b"), (f["start"] - f["end"]).alias("c"), f["start"].alias("d"), f["ord"].alias("e"), f.alias("f")))
    kept = F.aggregate(F.array_sort(keyed), none(), lambda acc, k: F.when(F.exists(acc, lambda g: overlaps(k["f"], g)), acc).otherwise(F.concat(acc, F.array(k["f"]))))
    return placed(kept)


def placed(findings: Column) -> Column:
    """In text order."""
    return F.transform(F.array_sort(F.transform(findings, lambda f: F.struct(f["start"].alias("a"), f["end"].alias("b"), f["ord"].alias("e"), f.alias("f")))), lambda k: k["f"])


def resolve(findings: Column) -> Column:
    """The best of what overlaps, in text order. A cluster begins where a finding starts behind all that were before it; only within one can
    findings overlap, so the greedy choice is made there."""

    def chosen(all_: Column) -> Column:
        fresh = running(all_, F.lit(-1), lambda end, f: F.greatest(end, f["end"]), lambda end, f: f["start"] >= end, "boolean")
        firsts = lambda new: F.filter(F.transform(new, lambda n, i: F.when(n, i)), lambda i: i.isNotNull())
        cluster = lambda at, i, i_next: F.slice(all_, at + 1, F.coalesce(i_next, F.size(all_)) - at)
        one = lambda c: F.when(F.size(c) == 1, c).otherwise(greedy(c))
        several = lambda new: bound(firsts(new), lambda starts: F.flatten(F.transform(starts, lambda at, i: bound(cluster(at, i, F.get(starts, i + 1)), one))))
        return bound(fresh, lambda new: F.when(F.forall(new, lambda n: n), all_).otherwise(several(new)))

    return F.when(F.size(findings) < 2, findings).otherwise(bound(placed(findings), chosen))


@lru_cache(maxsize=64)
def expression(application: str, text_col: str, chosen: tuple[Recognizer, ...], least_confidence: float, resolved: bool = True) -> Column:
    """Findings of the recognizers; made once for each choice, for it takes longer than many a query."""
    text = F.col(text_col)
    order = {r.name: k for k, r in enumerate(RECOGNIZERS)}
    if not chosen:
        return F.when(text.isNotNull() | text.isNull(), none())

    def found(segment: Column) -> Column:
        every = F.flatten(F.array(*[recognize(segment, r, order.get(r.name, k)) for k, r in enumerate(chosen)]))
        sure = F.filter(every, lambda f: f["confidence"] >= least_confidence)
        return F.transform(bound(sure, resolve) if resolved else sure, lambda f: moved(f, segment["at"]))

    # findings of two segments can't overlap
    everywhere = F.flatten(F.transform(segments(text, not all(r.breaks for r in chosen)), found))
    return F.when(text.rlike(r"(?U)[\d@]"), everywhere).otherwise(none())


def each(df: DataFrame, array: str, *keep: str, name: str = "f") -> DataFrame:
    """A row for each element of an array column, with the columns to keep.

    A plain explode would have Spark filter by the array's size below the projection that makes it, and so scan every text twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def scan(
    df: DataFrame,
    text_col: str = "text",
    recognizers: Iterable[Recognizer] = RECOGNIZERS,
    least_confidence: float = LEAST_CONFIDENCE,
    model_col: str | None = None,
    engines: Iterable[str] = (),
    out: str = "findings",
    resolved: bool = True,
) -> DataFrame:
    """Adds findings, engines and text_length. A null text has no findings and no length.

    Texts without a digit or an at sign are passed over in one test. model_col: findings of a model, see from_model. resolved: only the
    best of what overlaps; else what each recognizer finds alone.
    """
    text = F.col(text_col)
    chosen, app = tuple(recognizers), df.sparkSession.sparkContext.applicationId
    found = expression(app, text_col, chosen, least_confidence, resolved)
    if model_col:
        sure = F.filter(from_model(text, F.col(model_col)), lambda f: f["confidence"] >= least_confidence)
        # a model's span may lie across segments, and what it hides may hide others, so all are resolved again together
        every = F.concat(expression(app, text_col, chosen, least_confidence, False), sure)
        found = bound(every, resolve) if resolved else every
    return (
        df.withColumn(out, found)
        .withColumn("engines", F.array(*[F.lit(e) for e in dict.fromkeys(["regex", *engines])]))
        .withColumn("text_length", F.length(text))
    )


def scan_packs(df: DataFrame, packs: Iterable[str], text_col: str = "text", least_confidence: float = LEAST_CONFIDENCE, out: str = "packs") -> DataFrame:
    """Adds an array of pack and findings, a scan for each jurisdiction pack: each pattern is looked for once, and only what overlaps is settled pack by pack."""
    names = {pack: [r.name for r in select([pack])] for pack in packs}
    chosen = tuple(r for r in RECOGNIZERS if any(r.name in own for own in names.values()))
    every = expression(df.sparkSession.sparkContext.applicationId, text_col, chosen, least_confidence, False)
    told = F.array(*[F.struct(F.lit(pack).alias("pack"), F.array(*[F.lit(f"regex:{n}") for n in own]).alias("names")) for pack, own in names.items()])
    settled = lambda all_, p: bound(F.filter(all_, lambda f: F.array_contains(p["names"], f["recognizer"])), resolve)
    return df.withColumn(out, bound(every, lambda all_: F.transform(told, lambda p: F.struct(p["pack"].alias("pack"), settled(all_, p).alias("findings")))))


def entity_counts(findings: Column) -> Column:
    """Map of label to number of findings, labels in the order they first occur."""
    labels = F.transform(findings, lambda f: f["entity_type"])
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda e: F.struct(e, F.size(F.filter(labels, lambda x: x == e)))))
