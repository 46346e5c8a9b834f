"""Cross-tokenizer alignment: two tokenizers over the same bytes, cut where tokens of both end.

A slice of documents is laid end to end. The ends of A and of B tokens are counted once over its bytes (bincount); where both
have one, a group ends. Between two neighbouring ends of either kind lies exactly one A and one B token, so ends are links, and
prefix sums at the documents' bounds give their sums. Every slice is written as one row: what its documents have, its distinct id
pairs with the number of documents that hold each, and each document's pairs as places in that list.

A pair's count comes from the lists alone, and goes back to them, one row a slice and pair, so that no row is made for a document
and pair. A pair that all slices hold is a key of many rows on one side of a join and of one row on the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices
from .packing import Encoder

#: Characters of a slice, unless one document has more.
SLICE = 2_000_000
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SLICES = "slice long, doc_ids array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, sizes array<int>, places binary, times binary, pairs array<long>, held array<int>"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others are 256, 257 and so on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, bytes of ids, and ids as they are written in a digest, with either separator after them."""

    def __init__(self, table: list[bytes], inner: str, outer: str):
        self.table = table
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.written = [f"{i}{mark}" for i in range(len(table)) for mark in (inner, outer)]

    def spells(self, ids: np.ndarray, want: bytes) -> bool:
        return int(self.sizes[ids].sum()) == len(want) and b"".join(map(self.table.__getitem__, ids.tolist())) == want


class Aligner:
    """a: a tokenizers file of byte-level BPE, with ranks as in packing.Encoder; b: a sentencepiece model, which adds the space itself."""

    def __init__(self, a: str, ranks: str | None, b: str):
        import sentencepiece

        self.encoder = Encoder(a, ranks)
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.added = re.compile(r"(?!)")  # strings of added tokens are plain text here, which rank files know
        letters = byte_letters()
        vocabulary = self.encoder.tokenizer.get_vocab()
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = Side(table, ",", "|")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        piece = self.pieces.id_to_piece
        self.b = Side([bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.pieces.get_piece_size())], ",", ";")

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """Ids by A, ids by B and bytes of each text; none where the bytes of either differ from those of space and text."""
        none = np.empty(0, np.uint32)
        a, b, sizes = [], [], []
        for text, ids in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1), strict=True):
            want = b" " + text.encode("utf-8", "surrogatepass") if text else b""
            x = np.frombuffer(self.encoder.encode(f" {text}"), "<u4") if text else none
            y = np.array(ids, np.uint32) if text else none
            good = self.a.spells(x, want) and self.b.spells(y, want)
            a.append(x if good else none)
            b.append(y if good else none)
            sizes.append(len(want) if good else 0)
        return a, b, sizes

    def align(self, texts: list[str | None]) -> dict[str, object]:
        """The columns of SLICES but slice and doc_ids."""
        by_doc = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in by_doc[:2])
        a, b = (np.concatenate([*side, np.empty(0, np.uint32)]).astype(np.int64) for side in by_doc[:2])
        bounds = np.cumsum([0, *by_doc[2]])  # byte offsets of documents
        total = int(bounds[-1])
        in_a = np.bincount(np.cumsum(self.a.sizes[a]), minlength=total + 1)
        in_b = np.bincount(np.cumsum(self.b.sizes[b]), minlength=total + 1)
        ends = np.flatnonzero(in_a + in_b)
        cut = (in_a[ends] & in_b[ends]).astype(bool)
        # the token that an end closes or that goes on over it is the one after all that ended before
        at_a, at_b = np.cumsum(in_a[ends]) - in_a[ends], np.cumsum(in_b[ends]) - in_b[ends]
        links = np.searchsorted(ends, bounds, "right")  # prefix sums of links, at the bounds
        groups = np.concatenate([[0], np.cumsum(cut)])[links]
        doc = np.repeat(np.arange(len(texts)), np.diff(links))
        pair = a[at_a] * len(self.b.table) + b[at_b]
        width = len(self.a.table) * len(self.b.table)
        own, times = np.unique(doc * width + pair, return_counts=True)
        pairs, places, held = np.unique(own % width, return_inverse=True, return_counts=True)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": np.diff(links), "digests": self.digests(a, b, at_a, at_b, cut, n_a, n_b),
            "sizes": np.bincount(own // width, minlength=len(texts)).astype(np.int32), "places": places.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes(),
            "pairs": pairs, "held": held.astype(np.int32),
        }

    def digests(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, cut: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """Of each document, SHA-256 of its groups as text: A ids, a bar, B ids, groups apart by semicolons; '' without tokens."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a[cut]] = last_b[at_b[cut]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # all A ids of a group, then its B ids: a token stands after all tokens of earlier groups, and B's after the group's A's
        before_b, upto_a = np.concatenate([[0], np.flatnonzero(last_b) + 1]), np.flatnonzero(last_a) + 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before_b[group_a]] = 2 * a + last_a
        out[np.arange(len(b)) + upto_a[group_b]] = 2 * b + last_b + len(self.a.written)
        written = [*self.a.written, *self.b.written]
        found, bounds = [], np.cumsum(np.concatenate([[0], n_a + n_b]))
        for k in range(len(n_a)):
            part = "".join(map(written.__getitem__, out[bounds[k] : bounds[k + 1]].tolist()))
            found.append(hashlib.sha256(part[:-1].encode()).hexdigest() if part else "")
        return found


@lru_cache(maxsize=2)
def aligner(a: str, ranks: str | None, b: str) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(a, ranks, b)


def alignments(docs: DataFrame, a: str, ranks: str | None, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose bytes either tokenizer changes, have no tokens: zeros and ''. Rows are documents: repeated
    ones, and ones without an id, count by themselves. An empty table gives an empty result. Other columns are not read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, part = aligner(a, ranks, b), TaskContext.get().partitionId()
        for k, pdf in enumerate(text_slices(batches, "t", SLICE)):
            yield pd.DataFrame([{"slice": (part << 32) + k, "doc_ids": pdf["id"].tolist(), **both.align(pdf["t"].tolist())}])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                counts, best = np.zeros(len(row.order), np.int64), np.zeros(len(row.order), np.int64)
                order = np.array(row.order, np.int64)
                counts[order], best[order] = row.counts, row.best
                places, times = np.frombuffer(row.places, "<u4"), np.frombuffer(row.times, "<u4").astype(np.int64)
                bounds = np.cumsum([0, *row.sizes])
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[places])])[bounds]) for x in (best, counts)]
                ids = pd.array([None if x is None else int(x) for x in row.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": ids, "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups, "n_links": row.n_links, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row.digests})

    # an id may be null, and pandas would make floats of such a column: it travels as text
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("t"))
    slices = materialise(texts.mapInPandas(read, SLICES), "slices", "zstd")
    each = slices.select("slice", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("slice", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = each.groupBy("pair").agg(F.sum("held").alias("count"))
    # an A id has at most as many pairs as B has ids
    from_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(vocabulary_size(b))))
    counts = materialise(counts.withColumn("best", (F.col("count") == F.max("count").over(from_a)).cast("int")), "pair-counts")
    told = each.select("slice", "at", "pair").join(counts, "pair").groupBy("slice")
    told = told.agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))
    told = told.select("slice", F.col("told.at").alias("order"), F.col("told.count").alias("counts"), F.col("told.best").alias("best"))
    empty = [F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("order", "int"), ("counts", "long"), ("best", "int"))]
    both = slices.drop("pairs", "held").join(told, "slice", "left").select(*slices.drop("pairs", "held").columns, *empty)
    return both.mapInPandas(summed, RESULT)


def vocabulary_size(b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
