"""Repeated passages by sparse suffix arrays.

Of all suffixes only those at minimisers are kept: in every window of MIN_WORDS words the start of the least K-word hash. Two
occurrences of a passage of MIN_WORDS words choose the same places in it, so their suffixes share K words. The kept suffixes
are sorted over the whole corpus by their first K words (by a fingerprint of these, an order like any other) and compared
with their neighbours: one that has no neighbour of another document goes. What stays is extended left and right over the
stretch of words whose windows chose it: suffixes with equal stretches extend alike, and where neighbours differ, their
stretches' words are read again and every window of a run is compared, word by word, with the next in order. So a match that
a nearer neighbour hides is found too, a run of thousands of suffixes costs no more than its different stretches, and no
pair is ever made.

Sorting is by range, so a run of any size is dealt over as many tasks as it needs: what a task can't settle alone is the run at
either end of its range, and these ends are exchanged as a small table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, identified, materialise, mix, text_slices

MIN_WORDS = 50
K = 16
#: Rows a task sorts and holds at once: some tens of megabytes. Stretches and windows of the extension count likewise.
ROWS_A_TASK, STRETCHES_A_TASK = 500_000, 20_000
#: Ends of ranges (tens of bytes each) that a task is told of as they are.
ENDS_HELD = 100_000
#: Windows that are compared word by word at once.
COMPARED = 1 << 15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Prefixes:
    """Fingerprints of any run of words of a text, from running sums of powers (mod 2^64)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = _BASE
        inverse = np.ones(n + 1, np.uint64)
        inverse[1:] = _INVERSE
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(powers)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def stretches(words: np.ndarray, min_words: int = MIN_WORDS, k: int = K) -> tuple[np.ndarray, ...]:
    """(key, fingerprint, first window, number of windows) of each stretch of windows that chose the same suffix."""
    n = len(words) - min_words + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 4
    p = Prefixes(mix(words))
    at = np.arange(len(words) - k + 1)
    order = p.of(at, at + k)
    chosen = sliding_window_view(order, min_words - k + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    count = np.diff(np.append(first, n))
    return order[chosen[first]], p.of(first, first + count + min_words - 1), first, count


def suffix_rows(docs: DataFrame, min_words: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """key, seg, doc_id, start, windows for the stretches of all documents; documents with a null id have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for pdf in text_slices(batches, "t"):
            parts = []
            for doc, text in zip(pdf["id"], pdf["t"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= min_words:
                    key, seg, first, count = stretches(hashes.of(words), min_words, k)
                    parts.append((key.view(np.int64), seg.view(np.int64), np.full(len(key), doc), first.astype(np.int32), count.astype(np.int32)))
            if parts:
                yield pd.DataFrame(dict(zip(("key", "seg", "doc_id", "start", "windows"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return read.mapInPandas(run, "key long, seg long, doc_id long, start int, windows int")


def compare_neighbours(rows: DataFrame, levels: dict[str, list[str]], order: list[str], name: str, kinds: str | None = None, low: str = "low", high: str = "high") -> DataFrame:
    """Adds <level>_low and <level>_high, the least `low` and the largest `high` of all rows equal in a level's columns, and
    <kinds>_low and <kinds>_high, the least and largest value of the column `kinds` among rows equal in the first level's.

    rows is sorted by range; a level's columns lead the order, so equal rows are neighbours, and only those at either end of
    a task's range may have more in another task: these ends, at most two a level and task, are made known to all tasks, as
    they are if there are no more than ENDS_HELD, else by a join. Rows
    that are known to be alone in the first level (low = high) go, as do rows that equal the one before in all of `order`. rows
    is read twice, so it should be a written table.
    """
    first_level = next(iter(levels))
    extremes = [(level, level, low, high) for level in levels] + ([(kinds, first_level, kinds, kinds)] if kinds else [])
    names = [f"{made}_{x}" for made, *_ in extremes for x in ("low", "high")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        del parts
        changed = {c: np.append(True, np.diff(pdf[c].to_numpy()) != 0) for c in order}
        added = {"again": ~np.logical_or.reduce(list(changed.values()))}
        for made, level, a, b in extremes:
            new = np.logical_or.reduce([changed[c] for c in levels[level]])
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            least, most = np.minimum.reduceat(pdf[a].to_numpy(), first), np.maximum.reduceat(pdf[b].to_numpy(), first)
            end = (np.arange(len(first)) == 0) | (np.arange(len(first)) == len(first) - 1)
            added |= {f"{made}_low": least[group], f"{made}_high": most[group], f"{made}_end": end[group]}
        pdf = pdf.assign(**added)
        for at in range(0, len(pdf), 50_000):
            yield pdf.iloc[at : at + 50_000]

    added = ["again boolean"] + [f"{made}_{x} {kind}" for made, *_ in extremes for x, kind in (("low", "long"), ("high", "long"), ("end", "boolean"))]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + added)
    tasks = tasks_for(rows, ROWS_A_TASK)
    marked = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(run, schema)
    out = materialise(marked.where(f"NOT again AND ({first_level}_low < {first_level}_high OR {first_level}_end)").drop("again"), name)
    ends = {}
    for level, columns in levels.items():
        own = [made for made, by, *_ in extremes if by == level]
        extreme = [g(f"{m}_{x}").alias(f"_{m}_{x}") for m in own for x, g in (("low", F.min), ("high", F.max))]
        ends[level] = own, columns, materialise(out.where(f"{level}_end").groupBy(*columns).agg(*extreme), f"{name}-ends")
    if 2 * tasks <= ENDS_HELD:
        held = [(level, own, columns, table.toPandas()) for level, (own, columns, table) in ends.items()]

        def exchange(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for level, own, columns, table in held:
                    at = pdf[f"{level}_end"].to_numpy()
                    if not at.any():
                        continue
                    told = pdf.loc[at, columns].merge(table, on=columns, how="left")
                    for m in own:
                        for x in ("low", "high"):
                            pdf.loc[at, f"{m}_{x}"] = told[f"_{m}_{x}"].to_numpy()
                yield pdf

        settled = out.mapInPandas(exchange, out.schema)
    else:
        settled = out
        for own, columns, table in ends.values():
            settled = settled.join(table, columns, "left")
            settled = settled.withColumns({f"{m}_{x}": F.coalesce(f"_{m}_{x}", f"{m}_{x}") for m in own for x in ("low", "high")})
    return settled.select(*rows.columns, *names).where(f"{first_level}_low < {first_level}_high")


def tasks_for(rows: DataFrame, each: int) -> int:
    """Tasks of at most `each` rows; fewer than the session's number of partitions only where rows are few."""
    n = rows.count()
    return max(1, -(-n // each), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 5_000))


def stretch_words(docs: DataFrame, wanted: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """key, seg, low, high, starts, words (64-bit hashes) of the stretches in wanted (rep, places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for pdf in text_slices(batches, "t"):
            rows = []
            for doc, text, places in zip(pdf["rep"], pdf["t"], pdf["places"], strict=True):
                words = hashes.of(text.encode("utf-8", "surrogatepass").split())
                p = Prefixes(mix(words))
                for x in places:
                    at = x["starts"][0]
                    end = at + x["windows"] + min_words - 1
                    # another text of this id may have other words there
                    if end <= len(words) and p.of(np.array([at]), np.array([end])).view(np.int64)[0] == x["seg"]:
                        rows.append((x["key"], x["seg"], doc, x["high"], x["starts"], words[at:end].tobytes()))
            yield pd.DataFrame(rows, columns=["key", "seg", "low", "high", "starts", "words"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    return texts.join(wanted, "rep").select("rep", "t", "places").mapInPandas(run, "key long, seg long, low long, high long, starts array<int>, words binary")


def equal_windows(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the n-word windows at `at`, and which of them, in that order, differs from the one before. Words decide."""
    f = Prefixes(mix(words)).of(at, at + n)
    order = np.argsort(f, kind="stable")
    for exact in (False, True):
        new = np.ones(len(at), bool)
        alike = np.arange(1, len(at)) if exact else np.flatnonzero(f[order][1:] == f[order][:-1]) + 1
        for k in range(0, len(alike), COMPARED):
            x, y = (at[order[alike[k : k + COMPARED] - b]][:, None] + np.arange(n) for b in (0, 1))
            new[alike[k : k + COMPARED]] = (words[x] != words[y]).any(axis=1)
        if exact or not new[alike].any():
            return order, new
        order = np.lexsort(words[at[:, None] + np.arange(n)].T)  # two windows have one fingerprint: sorted by their words instead
    raise AssertionError


def extended(stretches_: DataFrame, min_words: int) -> DataFrame:
    """key, seg, low, high, starts, at, windows, owner: runs of windows of the stretches that other documents have too.

    Sorted by range, a run of suffixes with equal first words is in one task but for those at either end of its range; these
    go on as single windows, which are sorted in turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        pdf = pdf[np.append(True, (np.diff(pdf["key"]) != 0) | (np.diff(pdf["seg"]) != 0))]
        key = pdf["key"].to_numpy()
        end = (key == key[0]) | (key == key[-1])
        yield pdf[end].assign(at=0, windows=0, owner=0)
        pdf = pdf[~end].reset_index(drop=True)
        if len(pdf):
            words = np.frombuffer(b"".join(pdf["words"]), np.uint64)
            sizes = pdf["words"].map(len).to_numpy() // 8
            row, inner = window_places(sizes, min_words)
            order, new = equal_windows(words, (np.cumsum(sizes) - sizes)[row] + inner, min_words)
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
            owner, last = np.empty_like(row), np.empty_like(row)
            owner[order] = np.minimum.reduceat(low[row[order]], first)[group]
            last[order] = np.maximum.reduceat(high[row[order]], first)[group]
            # runs of windows of a stretch: matched ones that are first here, matched ones that are not
            state = np.where(owner == last, 0, np.where(owner == low[row], 1, 2))
            cut = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(state) != 0)))
            found = state[cut] > 0
            made = pdf.loc[row[cut[found]], ["key", "seg", "low", "high", "starts"]]
            yield made.assign(words=None, at=inner[cut[found]], windows=np.diff(np.append(cut, len(row)))[found], owner=np.minimum.reduceat(owner, cut)[found])

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000].reset_index(drop=True)
                words = np.frombuffer(b"".join(part["words"]), np.uint64)
                sizes = part["words"].map(len).to_numpy() // 8
                row, inner = window_places(sizes, min_words)
                place = (np.cumsum(sizes) - sizes)[row] + inner
                marks = (Prefixes(mix(x)).of(place, place + min_words).view(np.int64) for x in (words, ~words * _BASE))
                made = part.loc[row, ["key", "seg", "low", "high", "starts"]]
                yield made.assign(**dict(zip(("f1", "f2"), marks, strict=True)), at=inner.astype(np.int32))

    kinds = "key long, seg long, low long, high long, starts array<int>"
    dealt = stretches_.repartitionByRange(tasks_for(stretches_, STRETCHES_A_TASK), "key", "seg").sortWithinPartitions("key", "seg")
    done = materialise(dealt.mapInPandas(run, f"{kinds}, words binary, at int, windows int, owner long"), "extended")
    ends = materialise(done.where("words IS NOT NULL").mapInPandas(single, f"{kinds}, f1 long, f2 long, at int"), "end-windows")
    again = compare_neighbours(ends, {"same": ["f1", "f2"]}, ["f1", "f2", "seg", "at"], "end-windows-sorted")
    out = ["key", "seg", "low", "high", "starts", "at", "windows", "owner"]
    return done.where("words IS NULL").select(*out).unionByName(again.withColumn("windows", F.lit(1)).withColumn("owner", F.col("same_low")).select(*out))


def window_places(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of every n-word window of rows of `sizes` words."""
    counts = sizes - n + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    return row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, windows, owner: runs of windows that other documents have too; owner is the least of these documents."""
    rows = materialise(suffix_rows(docs, min_words, k, id_col, text_col), "suffixes")
    order = ["key", "seg", "doc_id", "start"]
    near = compare_neighbours(rows, {"run": ["key"], "own": ["key", "seg"]}, order, "suffixes-sorted", "seg", "doc_id", "doc_id")
    near = materialise(near.drop("run_high"), "near")
    # a stretch that the run's least document has and others have too: no neighbour can tell more of it
    settled = (F.col("own_low") < F.col("own_high")) & (F.col("own_low") == F.col("run_low"))
    whole = near.where(settled).select("doc_id", "start", "windows", F.col("own_low").alias("owner"))
    mixed = near.where(~settled)
    heads = near.where("seg_low < seg_high AND doc_id = own_low").groupBy("key", "seg").agg(F.first("own_low").alias("rep"), F.first("own_high").alias("high"), F.first("windows").alias("windows"), F.collect_set("start").alias("starts"))
    wanted = heads.groupBy("rep").agg(F.collect_list(F.struct("key", "seg", "windows", "high", "starts")).alias("places"))  # a text's own stretches
    found = extended(materialise(stretch_words(docs, wanted, min_words, id_col, text_col), "stretches"), min_words)
    own = found.select(F.col("low").alias("doc_id"), F.explode(F.transform("starts", lambda s: s + F.col("at"))).alias("start"), "windows", "owner")
    # the other documents that have such a stretch are never first; they learn of earlier documents from the stretch's row
    told = found.where("owner < low AND low < high").groupBy("key", "seg").agg(F.min("owner").alias("low"))
    told = told.select("key", "seg", F.lit(0).cast("long").alias("doc_id"), F.lit(-1).alias("start"), F.lit(0).alias("windows"), "low", F.col("low").alias("high"))
    copies = mixed.where("doc_id > own_low").select("key", "seg", "doc_id", "start", "windows", F.col("own_low").alias("low"), F.col("doc_id").alias("high"))
    others = compare_neighbours(materialise(copies.unionByName(told), "copies"), {"seg": ["key", "seg"]}, order, "copies-sorted").where("start >= 0")
    return whole.unionByName(own).unionByName(others.select("doc_id", "start", "windows", F.col("seg_low").alias("owner")))


def passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per repeated passage of a document: doc_id, first (in no earlier document), start, end (words, end exclusive), words, owner.

    A passage is a longest stretch of words of which every window of min_words words is in another document too. Where that
    document has a smaller doc_id the stretch is repeated (first false), elsewhere it is the first occurrence; the two may
    overlap. owner is the least doc_id that has a part of it. Words are [^\\x20\\x09-\\x0D]+. Null texts and shorter ones have no
    passages; rows with a null id take no part; rows that share an id are one document; other columns are not read; an
    empty table gives an empty result.
    """
    found = repeated_windows(docs, min_words, k, id_col, text_col)
    found = found.withColumn("first", F.col("owner") == F.col("doc_id")).withColumn("to", F.col("start") + F.col("windows"))
    # a text's own windows: runs that touch are one passage
    before = Window.partitionBy("doc_id", "first").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "first").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = found.withColumn("gap", F.coalesce(F.col("start") > F.max("to").over(before), F.lit(True)).cast("int"))
    runs = gaps.withColumn("run", F.sum("gap").over(upto)).groupBy("doc_id", "first", "run")
    out = runs.agg(F.min("start").alias("start"), (F.max("to") + min_words - 1).cast("int").alias("end"), F.min("owner").alias("owner"))
    return out.select("doc_id", "first", "start", "end", (F.col("end") - F.col("start")).alias("words"), "owner")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    keep, at = [], 0
    for a, b in sorted(spans):
        a, b = min(a, len(starts) - 1), min(b, len(starts) - 1)
        if starts[b] > at:
            keep.append(data[at : max(at, starts[a])])
            at = starts[b]
    keep.append(data[at:])
    return b"".join(keep).decode("utf-8", "surrogatepass")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """docs with every passage cut that an earlier document has; all columns stay, n_chars (if there) is counted anew.

    Texts come in order of doc_id; those without one, and different texts that share one, are documents of their own and
    come after all others. Null texts and texts without a passage stay as they are, as do repeated rows, which are cut alike.
    """
    named = identified(docs)
    cut = passages(named, min_words, k, "uid", "row.text").where("NOT first").groupBy(F.col("doc_id").alias("uid"))
    cut = materialise(cut.agg(F.collect_list(F.struct("start", "end")).alias("spans")), "cuts")  # a text's own

    @F.pandas_udf("string")
    def cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)])

    both = named.join(cut, "uid", "left")
    some = both.where("spans IS NOT NULL").withColumn("text", cut_text("row.text", "spans"))
    made = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        made = made.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.where("spans IS NULL").select("row.*").unionByName(some.select(made.alias("row")).select("row.*"))
