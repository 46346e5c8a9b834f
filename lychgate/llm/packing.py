"""Pattern packing of token sequences by non-negative least squares.

A histogram of piece lengths (at most `capacity` bins, whatever the corpus holds) goes to the driver. Lengths are rounded up to
a grid, patterns of a few documents that fill a sequence are enumerated, non-negative least squares fit repeat counts to the
histogram, the counts are rounded, and what is left over is packed best-fit into the open sequences. The plan is again a
table of bounded size: for each length, which ranks go to which sequences. Documents find their place by their rank among
pieces of the same length, counted in two steps over hash buckets, so that no length is ever in one task.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices

CAPACITY = 2048
GRID_CELLS = 256
#: Hash buckets of a length within which ranks are counted: at least SALTS, and more where pieces are many.
SALTS, SALT_ROWS = 256, 200_000
#: Beyond the Latin blocks the two libraries may know different letters, so such texts go to the tokenizer file itself.
_OTHER = re.compile(r"[^\x00-\u024f]|[\x1c-\x1f\x85]")
#: Fixed value: the published split of byte-level BPE with 50,257 ids.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers file has them; added tokens are one id.

    path: a tokenizers file. ranks: the same vocabulary as a rank file, by which Latin texts are encoded about three times
    as fast with the same ids (a test holds them against each other).
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a rank file knows no added tokens, so texts that hold one go to the tokenizer file itself
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or _OTHER.search(text) or self.added.search(text):
            return self.plain(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def tokenise(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. The last id of a document is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer, ranks)
        for pdf in text_slices(batches, "t"):
            rows = []
            for doc, text in zip(pdf["id"], pdf["t"], strict=True):
                ids = encoder.encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
                for piece, (a, b) in enumerate(pairwise(cuts)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            yield out.assign(doc_id=pd.array([None if x is None else int(x) for x in out["doc_id"]], "Int64"))

    # an id may be null, and pandas would make floats of such a column: it travels as text
    read = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("t"))
    return read.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def patterns(cells: int, most: int = 3) -> list[tuple[int, ...]]:
    """Ascending tuples of up to `most` grid lengths that fill `cells` exactly."""
    out: list[tuple[int, ...]] = [(cells,)]
    if most >= 2:
        out += [(a, cells - a) for a in range(1, cells // 2 + 1)]
    if most >= 3:
        out += [(a, b, cells - a - b) for a in range(1, cells // 3 + 1) for b in range(a, (cells - a) // 2 + 1)]
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by accelerated projected gradients; a is sparse in effect, so a few hundred rounds do."""
    gram = a @ a.T
    v = np.ones(len(gram))
    for _ in range(30):
        v = gram @ v
        v /= np.linalg.norm(v) or 1
    step = 1 / max(float(v @ gram @ v) * 1.01, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, cells: int = GRID_CELLS) -> list[tuple[list[int], int]]:
    """Groups of like sequences: (lengths in order, how many). Uses every length as often as the histogram has it."""
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    order = sorted(left)
    groups: list[tuple[list[int], int]] = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    cells = min(cells, capacity)
    unit = -(-capacity // cells)
    cells = capacity // unit
    classes: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        classes[-(-n // unit)].append(n)
    forms = patterns(cells)
    target = np.zeros(cells + 1)
    for cell, ns in classes.items():
        if cell <= cells:
            target[cell] = sum(left[n] for n in ns)
    matrix = np.zeros((cells + 1, len(forms)))
    for k, form in enumerate(forms):
        for c in form:
            matrix[c, k] += 1
    scale = max(target.max(), 1.0)
    # large pieces matter more: a small one left over still fits somewhere
    weight = np.sqrt(np.arange(cells + 1) / cells) + 0.1
    x = non_negative_least_squares(matrix * weight[:, None], target / scale * weight) * scale
    open_groups: list[tuple[list[int], int]] = []
    for k in np.argsort(-x, kind="stable"):
        repeat, form = int(np.floor(x[k] + 0.25)), forms[k]
        while repeat > 0 and all(classes[c] for c in form):
            # the longest of each class first; runs of equal lengths are taken together
            chosen = [classes[c][-1] for c in form[1:]]
            # the shortest of the pattern is the longest piece that still fits, so that rounding up costs no room
            spare = capacity - sum(chosen)
            k = bisect.bisect_right(order, spare) - 1
            while k >= 0 and not left[order[k]]:
                del order[k]
                k -= 1
            chosen.insert(0, order[k] if k >= 0 and len(form) > 1 else classes[form[0]][-1])
            need: dict[int, int] = defaultdict(int)
            for n in chosen:
                need[n] += 1
            run = min(repeat, *(left[n] // m for n, m in need.items()))
            if run == 0:  # two of a class are wanted and one of this length is there: it is left to the best fit
                break
            open_groups.append((chosen, run))
            repeat -= run
            for n, m in need.items():
                left[n] -= m * run
                if not left[n]:
                    classes[-(-n // unit)].remove(n)
    return groups + best_fit(open_groups, left, capacity)


def best_fit(groups: list[tuple[list[int], int]], left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: like pieces go together into the fullest like sequences that have room."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for g in groups:
        room[capacity - sum(g[0])].append(g)
    rooms = sorted(room)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                per = capacity // n
                full, rest = divmod(count, per)
                for m, c in ((per, full), (rest, 1 if rest else 0)):
                    if c:
                        r = capacity - n * m
                        if not room[r]:
                            bisect.insort(rooms, r)
                        room[r].append(([n] * m, c))
                break
            r = rooms[k]
            form, c = room[r].pop()
            if not room[r]:
                rooms.pop(k)
            fit = min(r // n, count)
            used = min(c, count // fit)
            if c > used:
                if not room[r]:
                    bisect.insort(rooms, r)
                room[r].append((form, c - used))
            s = r - n * fit
            if not room[s]:
                bisect.insort(rooms, s)
            room[s].append((form + [n] * fit, used))
            count -= fit * used
    return [g for gs in room.values() for g in gs]


def places(groups: list[tuple[list[int], int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For each length its runs (first rank, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    first = 0
    for form, count in groups:
        at = 0
        for n in form:
            out[n].append((rank[n], first, at))
            rank[n] += count
            at += n
        first += count
    return sorted(out.items())


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, ..., length of 1 to capacity); one row stays one row.

    Pieces are written with a number of their own first, by which those of a length are dealt, so that equal rows are not one bucket.
    """
    spark, names = pieces.sparkSession, pieces.columns
    pieces = materialise(pieces.withColumn("_copy", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    schema = "length long, runs array<struct<rank: long, first: long, at: long>>"
    runs = spark.createDataFrame(table, schema)  # a row for each length, with a few runs each: bounded by capacity
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_copy"), F.lit(max(SALTS, sum(counts.values()) // SALT_ROWS))).cast("int"))
    within = Window.partitionBy("length", "_salt").orderBy("_copy")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = salted.withColumn("_row", F.row_number().over(within)).join(sums.select("length", "_salt", "_base"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    placed = ranked.join(F.broadcast(runs), "length")
    run = F.element_at(F.filter("runs", lambda x: x["rank"] <= F.col("_rank")), -1)
    placed = placed.withColumn("_run", run)
    return placed.select(
        *[placed[c] for c in names],
        (F.col("_run.first") + F.col("_rank") - F.col("_run.rank")).alias("sequence_id"),
        F.col("_run.at").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0. A document of more than `capacity` ids is cut into pieces of `capacity`, of which
    the first may be shorter. Repeated rows and null ids are documents like others; other columns are not read; an empty
    table gives an empty result.
    """
    return pack(tokenise(docs, tokenizer, ranks, capacity, id_col, text_col), capacity)
