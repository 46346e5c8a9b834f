"""Exact top-k inner products by KD-trees over shards.

The upper levels of one KD-tree, fitted on a bounded sample, deal vectors into shards, so that a shard's bounding box is tight; a
leaf that got more rows than a shard holds (equal vectors, say) is split by a hash. A shard's own tree - median splits down to
leaves with tight boxes - is built once and stored with it. Queries come in blocks, dealt by the same upper levels. A block
searches its own leaf's shard first; from then on each of its queries has a k-th best score, and a shard whose box can't
reach it is never sent that query. Rounds go on with the shards of the highest bounds, each with the k-th scores of the last,
until no shard can reach any. A shard visits its leaves in order of their bounds in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors in a shard; more where that would make more than about MOST_SHARDS, of which every task knows the boxes.
SHARD_ROWS, MOST_SHARDS = 16_384, 20_000
BLOCK_ROWS = 1_024
LEAF_ROWS = 256
#: Vectors that the upper levels are fitted on, at most; all are dealt by them. A leaf has some vectors of the sample at least.
SAMPLE_ROWS, SAMPLE_A_LEAF = 20_000, 8
#: Shards that a block is sent to in a round: one in the first, then twice as many each time up to this, then half as many more.
MOST_AT_ONCE = 64


def at_once(turn: int) -> int:
    doublings = MOST_AT_ONCE.bit_length() - 1
    return 2**turn if turn <= doublings else math.ceil(MOST_AT_ONCE * 1.5 ** (turn - doublings))


class KdTree:
    """Leaves of a KD-tree over the rows of x, as runs of an order, with their boxes."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.bounds: list[tuple[int, int]] = []
        todo = [(0, len(x))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                self.bounds.append((a, b))
                continue
            part = x[self.order[a:b]]
            d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            m = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, d], m)]  # equal values fall on either side
            todo += [(a, a + m), (a + m, b)]
        self.points = x[self.order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.bounds])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.bounds])

    @classmethod
    def stored(cls, points: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> KdTree:
        """A tree whose points were put in order when it was made."""
        tree = cls.__new__(cls)
        tree.order, tree.points, tree.low, tree.high = np.arange(len(points)), points, low, high
        tree.bounds = [(int(a), int(b)) for a, b in bounds]
        return tree

    def most(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest inner product that the leaf's box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def search(tree: KdTree, ids: np.ndarray, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its up to k best (ids, scores) of the tree that reach kth; rows with the query's own id are left out."""
    ids = ids[tree.order]
    bound = tree.most(q)
    turn = np.argsort(-bound, axis=1, kind="stable")
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = kth.astype(float)
    for r in range(bound.shape[1]):  # every query's r-th best leaf; queries at the same leaf are taken together
        leaf = turn[:, r]
        live = np.flatnonzero(np.take_along_axis(bound, leaf[:, None], 1)[:, 0] >= floor)
        if not len(live):
            break
        by = live[np.argsort(leaf[live], kind="stable")]
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            a, b = tree.bounds[leaf[part[0]]]
            s = q[part] @ tree.points[a:b].T
            s[own[part][:, None] == ids[None, a:b]] = -np.inf
            s[s < floor[part][:, None]] = -np.inf
            hit = np.flatnonzero((s > -np.inf).any(axis=1))
            if not len(hit):
                continue
            rows = part[hit]
            all_s = np.concatenate([best_s[rows], s[hit]], axis=1)
            all_i = np.concatenate([best_i[rows], np.broadcast_to(ids[a:b], (len(rows), b - a))], axis=1)
            if all_s.shape[1] > 4 * k:  # the k-th score first, then ties to the smaller id among what reaches it
                cut = -np.partition(-all_s, k - 1, axis=1)[:, k - 1]
                for n, row in enumerate(rows):
                    keep = np.flatnonzero(all_s[n] >= cut[n])
                    keep = keep[np.lexsort((all_i[n][keep], -all_s[n][keep]))[:k]]
                    best_s[row], best_i[row] = all_s[n][keep], all_i[n][keep]
            else:
                at = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best_s[rows], best_i[rows] = np.take_along_axis(all_s, at, 1), np.take_along_axis(all_i, at, 1)
            floor[rows] = np.maximum(floor[rows], best_s[rows, k - 1])
    for n in range(len(q)):
        good = best_s[n] > -np.inf
        yield n, best_i[n][good], best_s[n][good]


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dims): floor(scale * component); vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dims"))


class Upper:
    """Upper levels of a KD-tree: inner nodes in heap order, each with a dimension and a value; equal values go left."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dim, self.value = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
        parts = [sample]
        for node in range(2**levels - 1):
            part = parts[node]
            self.dim[node] = np.argmax(part.max(axis=0) - part.min(axis=0)) if len(part) else 0
            x = part[:, self.dim[node]]
            self.value[node] = np.median(x) if len(part) else 0
            parts += [part[x <= self.value[node]], part[x > self.value[node]]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] > self.value[node])
        return node - (2**self.levels - 1)


def upper_levels(rows: DataFrame, shard_rows: int) -> dict[int, Upper]:
    """By number of dimensions, for those with more vectors than a shard holds."""
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).collect()  # a row for each such width
    out = {}
    for dims, n in sizes:
        if dims == 0:
            continue
        own = rows.where(F.col("dims") == dims)
        part = own.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < math.ceil(min(1.0, 1.2 * SAMPLE_ROWS / n) * (1 << 20)))
        sample = np.array([r[0] for r in part.select("v").limit(SAMPLE_ROWS).collect()], float).reshape(-1, dims)
        levels = min(math.ceil(math.log2(n / shard_rows)), int(math.log2(max(1, len(sample) / SAMPLE_A_LEAF))))
        out[dims] = Upper(sample, max(0, levels))
    return out


def dealt(rows: DataFrame, upper: dict[int, Upper]) -> DataFrame:
    """Adds leaf, the place in the upper levels; 0 where there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = np.zeros(len(pdf), np.int32)
            dims = pdf["dims"].to_numpy()
            for width, tree in upper.items():
                at = np.flatnonzero(dims == width)
                if len(at):
                    leaf[at] = tree.leaf(np.stack(pdf["v"].to_numpy()[at]))
            yield pdf.assign(leaf=leaf)

    return rows.mapInPandas(run, "vec_id long, v array<double>, dims int, leaf int")


def as_bytes(x: np.ndarray) -> bytes:
    """Whole numbers as 32-bit floats where these hold them exactly, else as 64-bit ones; the first byte says which."""
    small = x.astype(np.float32)
    return b"\4" + small.tobytes() if (np.abs(x) < 2**24).all() else b"\10" + x.astype(np.float64).tobytes()


def as_matrix(data: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(data, np.float32 if data[:1] == b"\4" else np.float64, offset=1).astype(np.float64)
    return x.reshape(rows, -1) if len(x) else np.zeros((rows, 1))


def packed_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["v"].to_numpy()).reshape(len(pdf), -1)
    tree = KdTree(x if x.shape[1] else np.zeros((len(pdf), 1)))
    ids = pdf["vec_id"].to_numpy(np.int64)[tree.order]
    return pd.DataFrame(
        [{"dims": pdf["dims"].iloc[0], "leaf": pdf["leaf"].iloc[0], "part": pdf["part"].iloc[0], "ids": ids.tobytes(), "points": as_bytes(tree.points), "runs": np.array(tree.bounds, np.int64).tobytes(),
          "low": as_bytes(tree.low), "high": as_bytes(tree.high), "box": as_bytes(np.stack([tree.low.min(axis=0), tree.high.max(axis=0)]))}]
    )


def packed_block(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["v"].to_numpy()).reshape(len(pdf), -1)
    return pd.DataFrame([{"dims": pdf["dims"].iloc[0], "leaf": pdf["leaf"].iloc[0], "part": pdf["part"].iloc[0], "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "rows": pdf["query_row"].to_numpy(np.int64).tobytes(), "points": as_bytes(x if x.shape[1] else np.zeros((len(pdf), 1)))}])


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k best: query_id, rank (from 1), vec_id, score, query_row.

    Queries are the rows whose id is divisible by query_every; candidates are all rows of the same number of dimensions but
    those with the query's id; ties go to the smaller id. Null ids take no part; rows equal in id and vector count once;
    different vectors under one id are candidates and queries each by itself, which query_row, a hash, tells apart; an empty
    table gives an empty result. Scores are whole numbers, exact below 2^53.
    """
    rows = quantised(vectors, scale, id_col, vector_col).distinct()
    rows = materialise(rows, "vectors")
    shard_rows = max(SHARD_ROWS, -(-rows.count() // MOST_SHARDS))
    rows = materialise(dealt(rows, upper_levels(rows, shard_rows)), "dealt")
    is_query = F.col("vec_id") % query_every == 0
    sizes = materialise(rows.groupBy("dims", "leaf").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")), "leaves")  # a row for each leaf

    def parts(df: DataFrame, size: str, per: int, salt: str) -> DataFrame:
        n = F.greatest(F.ceil(F.col(size) / per), F.lit(1)).cast("int")
        joined = df.join(sizes.select("dims", "leaf", n.alias("_parts")), ["dims", "leaf"])
        return joined.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(salt)), "_parts").cast("int")).drop("_parts")

    box = "dims int, leaf int, part int, ids binary, points binary"
    shards = parts(rows, "n", shard_rows, "shard").groupBy("dims", "leaf", "part").applyInPandas(packed_shard, f"{box}, runs binary, low binary, high binary, box binary")
    shards = materialise(shards, "shards")
    asked = parts(rows.where(is_query), "q", BLOCK_ROWS, "block").withColumn("query_row", F.xxhash64("vec_id", "v"))
    blocks = asked.groupBy("dims", "leaf", "part").applyInPandas(packed_block, f"{box}, rows binary")
    blocks = materialise(blocks, "blocks")
    boxes: dict[int, list] = {}
    for r in shards.select("dims", "leaf", "part", "box").collect():  # two rows of numbers a shard: see MOST_SHARDS
        boxes.setdefault(r.dims, []).append((r.leaf, r.part, as_matrix(bytes(r.box), 2)))
    best, turn, query = None, 0, ["query_id", "query_row"]  # rows of one hash have another id, and the other way round
    while True:
        sent = materialise(wanted(blocks, boxes, best, k, turn), f"sent-{turn}")
        if turn and sent.isEmpty():
            break
        found = searched(sent, shards, k)
        found = found if best is None else best.unionByName(found)
        order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
        best = materialise(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"), f"best-{turn}")
        live = sent.where("leaf < 0").select("dims", F.col("home").alias("leaf"), F.col("block").alias("part"))
        blocks = blocks.join(live, ["dims", "leaf", "part"], "left_semi")
        turn += 1
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", F.col("score").cast("long").alias("score"), "query_row")


def wanted(blocks: DataFrame, boxes: dict[int, list], best: DataFrame | None, k: int, turn: int) -> DataFrame:
    """(dims, leaf, part) of the shards a block goes to in this turn, with those of its queries that the shard's box can serve.

    Shards are visited in the order of their bounds for the block, its own leaf first; turn t takes the next at_once(t) of them, so the last shard's turn
    comes whatever their number. That order never changes, so a block needs to know nothing but the turn and its k-th scores.
    """
    first = sum(map(at_once, range(turn)))
    last = first + at_once(turn)
    state = blocks.select("dims", F.col("leaf").alias("home"), F.col("part").alias("block"), "ids", "rows", "points")
    if best is None:
        state = state.withColumn("known", F.lit(None).cast("array<struct<query_id: long, query_row: long, floor: double>>"))
    else:
        kth = best.groupBy("dims", "home", "block", "query_id", "query_row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        kth = kth.groupBy("dims", "home", "block").agg(F.collect_list(F.struct("query_id", "query_row", "floor")).alias("known"))  # a block's own queries
        state = state.join(kth, ["dims", "home", "block"], "left")

    known = {dims: (np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.stack([x[2] for x in own])) for dims, own in boxes.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ids, rows = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64)
                q = as_matrix(r.points, len(ids))
                floor = np.full(len(ids), -np.inf)
                if r.known is not None and len(r.known):
                    told = {(x["query_id"], x["query_row"]): x["floor"] for x in r.known}
                    floor = np.array([told.get(i, -np.inf) for i in zip(ids.tolist(), rows.tolist(), strict=True)])
                leaf, part, pairs = known[r.dims]
                bound = np.maximum(q, 0) @ pairs[:, 1].T + np.minimum(q, 0) @ pairs[:, 0].T
                order = np.lexsort((-bound.max(axis=0), leaf != r.home))
                for s in order[first:last]:
                    live = np.flatnonzero(bound[:, s] >= floor)
                    if len(live):
                        out.append((r.dims, leaf[s], part[s], r.home, r.block, ids[live].tobytes(), rows[live].tobytes(), as_bytes(q[live]), floor[live].tobytes()))
                # a later shard may still serve a query: an empty row keeps the rounds going
                rest = order[last:]
                if len(rest) and (bound[:, rest] >= floor[:, None]).any():
                    out.append((r.dims, -1, -1, r.home, r.block, b"", b"", b"", b""))
            yield pd.DataFrame(out, columns=["dims", "leaf", "part", "home", "block", "qids", "qrows", "q", "kth"])

    return state.mapInPandas(run, "dims int, leaf int, part int, home int, block int, qids binary, qrows binary, q binary, kth binary")


def searched(sent: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Scores that may be among a query's k best: dims, home, block, query_id, query_row, vec_id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, own = np.frombuffer(r.ids, np.int64), np.frombuffer(r.qids, np.int64)
                runs = np.frombuffer(r.runs, np.int64).reshape(-1, 2)
                tree = KdTree.stored(as_matrix(r.points, len(ids)), runs, as_matrix(r.low, len(runs)), as_matrix(r.high, len(runs)))
                hits = list(search(tree, ids, as_matrix(r.q, len(own)), own, np.frombuffer(r.kth), k))
                at, many = [h[0] for h in hits], [len(h[1]) for h in hits]
                yield pd.DataFrame({"dims": r.dims, "home": r.home, "block": r.block, "query_id": np.repeat(own[at], many), "query_row": np.repeat(np.frombuffer(r.qrows, np.int64)[at], many), "vec_id": np.concatenate([h[1] for h in hits]).astype(np.int64), "score": np.concatenate([h[2] for h in hits])})

    pairs = sent.where("leaf >= 0").join(shards, ["dims", "leaf", "part"])
    return pairs.select("dims", "home", "block", "qids", "qrows", "q", "kth", "ids", "points", "runs", "low", "high").mapInPandas(run, "dims int, home int, block int, query_id long, query_row long, vec_id long, score double")
