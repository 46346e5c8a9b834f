"""Document fingerprints by Lempel-Ziv phrases.

A text is parsed into phrases, each the longest one seen before in this text and one code point more (LZ78). The set of phrases is
hashed, dealt into BINS, and the low byte of each bin's minimum is the fingerprint (one-permutation MinHash): texts that would
compress each other well have many phrases in common, and so many equal minima.

Edited texts need the next document in descending order of ids, so documents are sorted by range, once, and every task
walks through its range with the document before in hand. Only the first and last document of a range leave their task as
texts, two for each, to meet their neighbours in a join by range number.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, text_slices

BINS, BITS = 128, 8
#: Phrases are hashed as polynomials modulo 2^64; PLACE undoes the factor of a phrase's place in its text.
FACTOR = 0x9E3779B97F4A7C15
PLACE = pow(FACTOR, -1, 1 << 64)
#: An empty bin has the minimum of the next one that isn't, changed by the distance.
STEP = np.uint64(0xD6E8FEB86659FD93)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Phrases:
    """The dictionary of one text: a tree whose nodes are phrases. Takes time and memory linear in the text, however it repeats."""

    def __init__(self) -> None:
        self.grown: dict[int, int] = {}
        self.sizes = [0]
        self.node = 0

    def read(self, text: str) -> Phrases:
        grown, sizes, node = self.grown, self.sizes, self.node
        find, add = grown.get, sizes.append
        for c in array("I", text.encode("utf-32-le", "surrogatepass")):
            key = node << 21 | c
            node = find(key)
            if node is None:
                grown[key] = len(sizes)
                add(sizes[key >> 21] + 1)
                node = 0
        self.node = node
        return self

    def copy(self) -> Phrases:
        other = Phrases()
        other.grown, other.sizes, other.node = self.grown.copy(), self.sizes.copy(), self.node
        return other

    def fingerprint(self, text: str) -> str:
        """text: all that was read. The bins' low bytes in base64; empty without a phrase."""
        sizes = np.array(self.sizes[1:], np.int64)
        return signature(phrase_hashes(text, sizes)) if len(sizes) else ""


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1 and so on modulo 2^64; those of ordinary texts are kept."""
    return _powers(base, 1 << 16)[:n] if n <= 1 << 16 else _powers.__wrapped__(base, n)


def phrase_hashes(text: str, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases that follow one another from the text's start; what follows the last is an open phrase."""
    ends = np.cumsum(sizes)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")[: int(ends[-1])].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(FACTOR, len(codes)))])
    starts = ends - sizes
    return mix(mix((sums[ends] - sums[starts]) * powers(PLACE, len(codes))[starts]) + sizes.astype(np.uint64))


def signature(hashes: np.ndarray) -> str:
    hashes = np.unique(hashes)
    bins, first = np.unique(hashes >> np.uint64(64 - (BINS - 1).bit_length()), return_index=True)
    least, bins = hashes[first], bins.astype(np.int64)
    every = np.arange(BINS)
    taken = np.searchsorted(bins, every)
    away = np.where(taken < len(bins), bins[taken % len(bins)] - every, bins[0] + BINS - every)
    return base64.b64encode((mix(mix(least[taken % len(bins)]) + away.astype(np.uint64) * STEP) & np.uint64(2**BITS - 1)).astype(np.uint8).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two phrase sets, less what chance makes equal; equal fingerprints have 1, empty and other ones 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(base64.b64decode(s), np.uint8) for s in (a, b))
    chance = 2.0**-BITS
    return float(max(0.0, (np.mean(x == y) - chance) / (1 - chance)))


class Document:
    """A text with its fingerprint and the dictionary as it was where an edit would begin."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 2
        self.begun = Phrases().read(text[: self.cut])
        self.fingerprint = self.begun.copy().read(text[self.cut :]).fingerprint(text)

    def row(self, after: Document) -> tuple:
        """The result for this document with the one after it. It can be asked for once, for it goes on with the dictionary."""
        tail = after.text[: len(self.text) // 2]
        text = self.text[: self.cut] + tail
        edited = self.begun.read(tail).fingerprint(text)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.fingerprint, edited), likeness(self.fingerprint, after.fingerprint)
        return (self.doc_id, len(self.text), sha, self.fingerprint, edited, *near)


def number(x: str | None) -> int | None:
    return None if x is None else int(x)


def frame(rows: list[tuple], more: tuple[str, ...] = ()) -> pd.DataFrame:
    names = [c.split()[0] for c in RESULT.split(", ")]
    out = pd.DataFrame(rows, columns=[*names, *more])
    return out.assign(doc_id=pd.array(out["doc_id"].tolist(), "Int64"), n_chars=pd.array(out["n_chars"].tolist(), "Int64"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Edited: the last half (rounded down) of the code points replaced by the first as many, or all, of the next document in
    descending order of ids; after the last comes the first, which may be the document itself. Null texts count as empty; an
    empty text has an empty fingerprint. Rows that share an id follow by a hash of their texts, rows without one come last in
    that order; equal rows may be in any order, for it makes no difference to the result, and so are dealt over ranges. An
    empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("k"), text.alias("t"))
    order = [F.col("id").desc_nulls_last(), F.col("h"), F.col("k")]
    # an id may be null, and pandas would make floats of such a column: it travels as text
    ranged = read.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("id"), "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), None
        more = ("part", "last", "text")
        for pdf in text_slices(batches, "t"):
            rows = []
            for doc_id, t in zip(pdf["id"], pdf["t"], strict=True):
                doc = Document(number(doc_id), t)
                rows.append((*before.row(doc), None, None, None) if before else (doc.doc_id, *[None] * 6, part, False, t))
                before = doc
            yield frame(rows, more).astype({"part": "Int32", "last": "boolean"})
        if before:
            yield frame([(before.doc_id, *[None] * 6, part, True, before.text)], more).astype({"part": "Int32", "last": "boolean"})

    walked = materialise(ranged.mapInPandas(run, f"{RESULT}, part int, last boolean, text string"), "phrases", "zstd")
    ends = walked.where("part IS NOT NULL").select("part", "last", F.col("doc_id").cast("string").alias("id"), "text")
    # a number for each task of the sort, of which the driver keeps more than that
    parts = sorted(r.part for r in ends.where("last").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, follows int")
    heads = ends.where("NOT last").select(F.col("part").alias("follows"), F.col("id").alias("next_id"), F.col("text").alias("next_text"))
    pairs = ends.where("last").join(follows, "part").join(heads, "follows").select("id", "text", "next_id", "next_text")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_slices(batches, "text"):
            yield frame([Document(number(a), t).row(Document(number(b), u)) for a, t, b, u in zip(pdf["id"], pdf["text"], pdf["next_id"], pdf["next_text"], strict=True)])

    return walked.where("part IS NULL").drop("part", "last", "text").unionByName(pairs.mapInPandas(finish, RESULT))
