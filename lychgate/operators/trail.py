"""A trail of any size: events as a table, a hash tree over each batch of them, and a chain of roots.

An event's leaf is a hash of all that is told of it and of its batch. Leaves hang in a tree by their first hex digits, so the tree
is the same however the events are split, no branch is larger than another, and it is made by grouping, with no order of
rows and nothing but roots on the driver. A root is recorded in the chained log of `audit`; the record is what makes a batch
count. A proof that one event is in a batch is some hashes for each level, checked without the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import AuditLog

#: Lengths of the prefixes at which branches join, from the leaves' own branch to the root. 65,536 branches at the bottom.
LEVELS = (4, 2, 0)
EVENT = ("kind", "source_id", "payload")
SCHEMA = "kind string, source_id string, payload string, leaf string, batch string"


def leaf(batch: Column, kind: Column, source_id: Column, payload: Column) -> Column:
    """Every part with its length before it, so that no two events are written alike; null is told from empty."""
    sized = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-:")) for c in (batch, kind, source_id, payload)]
    return F.sha2(F.concat(*sized), 256)


def with_leaves(events: DataFrame, batch: Column) -> DataFrame:
    return events.select(*[F.col(c).cast("string").alias(c) for c in EVENT], batch.cast("string").alias("batch")).withColumn("leaf", leaf(F.col("batch"), *map(F.col, EVENT)))


def branches(leaves: DataFrame) -> list[DataFrame]:
    """For each level (batch, prefix, node, events): a branch is the hash of what hangs on it, in order. leaves: batch, leaf.

    Equal events are counted first, so that a million copies of one are one entry.
    """
    below = leaves.groupBy("batch", F.col("leaf").alias("prefix")).agg(F.count("*").alias("events"))
    below = below.withColumn("node", F.concat("prefix", F.lit("*"), F.col("events").cast("string")))
    out = []
    for size in LEVELS:
        node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "node"))), lambda c: c["node"]), "|"), 256)
        below = below.groupBy("batch", F.substring("prefix", 1, size).alias("prefix")).agg(node.alias("node"), F.sum("events").alias("events"))
        out.append(below)
    return out


def roots(leaves: DataFrame) -> DataFrame:
    """(batch, events, root)."""
    return branches(leaves)[-1].select("batch", "events", F.col("node").alias("root"))


@dataclass(frozen=True)
class Proof:
    """That an event is in a batch: for each level, the entries of the branch that it hangs on."""

    batch: str
    root: str
    levels: tuple[tuple[str, ...], ...]

    def holds(self, event: Mapping[str, str | None]) -> bool:
        """Checked with the event, this proof and a recorded root alone."""
        parts = (self.batch, *(event[c] for c in EVENT))
        own = hashlib.sha256("".join("-:" if p is None else f"{len(p)}:{p}" for p in parts).encode()).hexdigest()
        held = lambda entry: entry.split("*")[0] == own
        for k, entries in enumerate(self.levels):
            if not any(held(e) if k == 0 else e == own for e in entries):
                return False
            own = hashlib.sha256("|".join(entries).encode()).hexdigest()
        return own == self.root


class Trail:
    """Events in a folder that Spark reads, a folder a batch; their roots in a chained log."""

    def __init__(self, folder: str, log: AuditLog):
        self.folder, self.log = folder.rstrip("/"), log

    def place(self, stream: str, number: int) -> str:
        return f"{self.folder}/stream={stream}/number={number}"

    def append(self, events: DataFrame, stream: str, number: int, **more) -> str | None:
        """Writes a batch of events (kind, source_id, payload), then records its root: the root, or None if the trail has that batch.

        A batch that failed before its root was recorded does not count, and is written anew when it is run again.
        """
        name, spark = f"{stream}#{number}", events.sparkSession
        with_leaves(events, F.lit(name)).write.mode("overwrite").parquet(self.place(stream, number))
        got = roots(spark.read.schema(SCHEMA).parquet(self.place(stream, number))).first()
        root, n = (got.root, got.events) if got else (hashlib.sha256(b"").hexdigest(), 0)
        return root if self.log.append([("batch", stream, {"root": root, "events": n, "number": number, **more})], batch=name) else None

    def recorded(self, spark: SparkSession) -> DataFrame:
        """(stream, number, root, events) of the log's batches."""
        lines = spark.read.text(str(self.log.path)).select(F.from_json("value", "kind string, source_id string, number long, root string, events long").alias("r")).select("r.*")
        return lines.where("kind = 'batch'").select(F.col("source_id").alias("stream"), "number", "root", "events")

    def events(self, spark: SparkSession) -> DataFrame:
        """All events of recorded batches: kind, source_id, payload, leaf, batch, stream, number."""
        table = spark.read.schema(f"{SCHEMA}, stream string, number long").parquet(self.folder)
        return table.join(self.recorded(spark).select("stream", "number"), ["stream", "number"], "left_semi")

    def check(self, spark: SparkSession) -> DataFrame:
        """(stream, number, recorded, found, changed, whole) of each recorded batch: how many events it should have and has, how many are not
        what their leaf was made of, and whether the tree's root is the recorded one. An event that was changed, lost, added or
        moved to another batch makes its batches not whole. Nothing comes to the driver; the log itself is checked by audit.check."""
        table = self.events(spark).withColumn("own", leaf(F.concat_ws("#", "stream", F.col("number").cast("string")), *map(F.col, EVENT)))
        found = roots(table.select(F.struct("stream", "number").alias("batch"), F.col("own").alias("leaf"))).select("batch.*", F.col("root").alias("made"), F.col("events").alias("found"))
        changed = table.groupBy("stream", "number").agg(F.count_if(~F.col("own").eqNullSafe(F.col("leaf"))).alias("changed"))
        both = self.recorded(spark).join(found, ["stream", "number"], "left").join(changed, ["stream", "number"], "left")
        whole = F.coalesce(F.col("made") == F.col("root"), F.col("events") == 0)
        return both.select("stream", "number", F.col("events").alias("recorded"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("changed", F.lit(0)).alias("changed"), whole.alias("whole"))

    def proof(self, spark: SparkSession, stream: str, number: int, event: Mapping[str, str | None]) -> Proof:
        """Of an event in a batch: one branch a level comes to the driver, of n / 65,536, 256 and 256 entries."""
        name = f"{stream}#{number}"
        leaves = spark.read.schema(SCHEMA).parquet(self.place(stream, number)).select("batch", "leaf")
        own = spark.range(1).select(leaf(F.lit(name), *[F.lit(event[c]).cast("string") for c in EVENT])).first()[0]
        below = leaves.where(F.col("leaf").startswith(own[: LEVELS[0]])).groupBy(F.col("leaf").alias("prefix")).agg(F.count("*").alias("n"))
        levels = [tuple(f"{r.prefix}*{r.n}" for r in below.orderBy("prefix").collect())]
        made = branches(leaves)
        for lower, size in zip(made, LEVELS[1:], strict=False):
            levels.append(tuple(r.node for r in lower.where(F.col("prefix").startswith(own[:size])).orderBy("prefix").collect()))
        if not any(e.split("*")[0] == own for e in levels[0]):
            raise ValueError("the batch has no such event")
        return Proof(name, made[-1].first().node, tuple(levels))


