"""What the operators of this subpackage share: the shared scratch folder, word hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's hash cache before it starts anew (about 100 MB).
CACHE_WORDS = 400_000
#: Bits of a bitmap of keys: so many a key, and at most 2^MARK_BITS (16 MB), which all tasks know.
KEY_BITS, MARK_BITS = 64, 27
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset, a folder of our own, but only in local mode, where driver
    and executors are one process; on a cluster other machines could not see it, so there it is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lychgate-")
        context.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lychgate/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key (a hash, long) wanted has, and few others, by a bitmap of keys: what goes on to an exact join is about what it
    finds. Beyond 2^MARK_BITS / KEY_BITS keys the bitmap grows no more, and more of the others pass."""
    bits = min(MARK_BITS, max(15, (wanted.count() * KEY_BITS).bit_length()))
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    low = slot.bitwiseAND(F.lit(32767))  # of a bitmap's 4 kB
    maps = wanted.groupBy(F.shiftright(slot, 15).alias("_map")).agg(F.bitmap_construct_agg(low).alias("_bits"))
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(low, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", octet, low.bitwiseAND(F.lit(7)).cast("int"))
    return rows.join(F.broadcast(maps), F.shiftright(slot, 15) == F.col("_map")).where(bit == 1).select(*rows.columns)


def text_slices(batches: Iterator[pd.DataFrame], column: str, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Arrow batches (of up to 64 MB) cut into runs of rows whose texts have about `most` characters, so that results stay small."""
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = np.fromiter((0 if t is None else len(t) for t in pdf[column]), np.int64, len(pdf))
        part = np.cumsum(sizes + 100) // most
        for run in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(part)) + 1):
            yield pdf.iloc[run[0] : run[-1] + 1]


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, row): rows of docs as structs, so that no column of theirs clashes with ours, and a long that names the text.

    That is the id, or, without one or where other texts have it too, a hash of id and text of 2^62 or more. Repeated rows have
    one uid. Ids are taken to be below 2^62.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own, text = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`")
    mark = F.xxhash64(text)
    shared = rows.where(own.isNotNull()).groupBy(own.alias("id")).agg(F.min(mark).alias("a"), F.max(mark).alias("b"))
    shared = materialise(shared.where("a <> b").select("id"), "shared-ids")
    made = F.shiftrightunsigned(F.xxhash64(own, text, F.lit("uid")), 2).bitwiseOR(F.lit(1 << 62))
    if shared.isEmpty():
        return rows.select(F.coalesce(own, made).alias("uid"), "row")
    both = rows.join(shared, own == F.col("id"), "left")
    return both.select(F.when(own.isNull() | F.col("id").isNotNull(), made).otherwise(own).alias("uid"), "row")


class WordHash(dict):
    """64-bit hashes of words (bytes), the same on every executor."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached over edges (a, b).

    Every round hooks each node to its least neighbour, takes one more step down, and contracts the edges: of two nodes that
    share an edge at least the larger one goes, so edges shrink from round to round and rounds grow with the logarithm
    of the nodes. Labels and links stay on the cluster, written each round. Nodes without an edge do not appear; edges
    with a null end are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    left = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    total = None
    for _ in range(most_rounds):
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("hook")), "hooks")
        far = hook.select(F.col("u").alias("hook"), F.col("hook").alias("far"))
        down = materialise(hook.join(far, "hook").select("u", F.col("far").alias("to")), "labels")
        if total is None:
            total = down.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            step = down.select(F.col("u").alias("component"), "to")
            total = materialise(total.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        first = left.join(down, "u").select(F.col("to").alias("x"), "v")
        ends = first.join(down.select(F.col("u").alias("v"), F.col("to").alias("y")), "v").where("x <> y")
        left = materialise(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        if left.isEmpty():
            return total
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
