"""Sharding by fixed virtual slots, with DataFrame operations only.

A record's slot is a hash of its id, so it never moves between slots; records without an id of their own are spread by text and
copy number, so that no id is a hot slot. Bytes are summed for each slot; the slot-to-shard map is a small table, stored as
<path>/version=n. The first version deals slots by turns; every run reads the latest, and where shards have become uneven, or
there are more of them or fewer, moves as few slots as it takes and stores the next version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path

SLOTS = 4096
SHARDS = 16
#: Parts of equal rows within which copies are numbered.
SALTS = 256
#: Rows of a slot that are numbered in one task; larger slots are numbered in parts.
PART_ROWS = 500_000
#: Shards may differ from the mean by this share before slots are moved.
SLACK = 0.001


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("slot")), F.lit(slots)).cast("int")


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds virtual_slot to rows (doc_id, size, text_crc32), which are read more than once.

    An id that one row has gives that row's slot. Rows with a null or repeated id go by id, size, crc32 and their number among
    rows that are equal in these, so the slots of a table are the same in whatever order it is read.
    """
    repeated = materialise(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_again")), "repeated")
    marked = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(repeated, "doc_id", "left")
    marked = materialise(marked.withColumn("_again", F.col("doc_id").isNull() | F.coalesce("_again", F.lit(False))), "marked")
    once = marked.where("NOT _again").select(*rows.columns, slot_of(F.col("doc_id"), slots).alias("virtual_slot"))
    again = marked.where("_again").withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "size", "text_crc32"))
    sums = again.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTS rows
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_key", "_part", "_base")
    within = Window.partitionBy("_key", "_part").orderBy("_part")
    copies = again.withColumn("_row", F.row_number().over(within)).join(sums, ["_key", "_part"])
    slot = F.pmod(F.xxhash64("_key", F.col("_base") + F.col("_row"), F.lit("slot")), F.lit(slots)).cast("int")
    return once.unionByName(copies.select(*rows.columns, slot.alias("virtual_slot")))


def rebalance(old: list[int], sizes: list[int], shards: int, slack: float = SLACK) -> list[int]:
    """The next version of a map: slots move from the heaviest shard to the lightest until loads are within `slack` of the mean.

    New shards begin empty; slots of shards that are gone go, largest first, to the lightest. Slots that need not move stay.
    """
    out, load, own = list(old), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += sizes[slot]
            own[shard].append(slot)
    for slot in sorted((k for k, shard in enumerate(old) if shard >= shards), key=lambda k: (-sizes[k], k)):
        out[slot] = low = min(range(shards), key=load.__getitem__)
        load[low] += sizes[slot]
        own[low].append(slot)
    mean = sum(load) / shards
    for _ in range(4 * len(sizes)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        moves = [s for s in own[high] if 0 < sizes[s] < gap]
        if load[high] <= mean * (1 + slack) and load[low] >= mean * (1 - slack) or not moves:
            break
        slot = min(moves, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        own[high].remove(slot)
        own[low].append(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
        out[slot] = low
    return out


def latest_map(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(version, shard of each slot) of the latest map under path; (0, []) if there is none yet."""
    try:
        found = spark.read.schema("virtual_slot int, map_shard int, version int").parquet(path)
    except AnalysisException:  # no such folder
        return 0, []
    version = found.agg(F.max("version")).first()[0] or 0
    rows = found.where(F.col("version") == version).orderBy("virtual_slot").collect()  # a row for each slot
    return version, [r.map_shard for r in rows]


def store_map(spark: SparkSession, path: str, version: int, chosen: list[int]) -> None:
    """Writes a version; one that is there already is never written over."""
    at = F.element_at(F.split(F.lit(",".join(map(str, chosen))), ","), (F.col("id") + 1).cast("int")).cast("int")
    table = spark.range(0, len(chosen), 1, 1).select(F.col("id").cast("int").alias("virtual_slot"), at.alias("map_shard"))
    table.write.mode("errorifexists").parquet(f"{path}/version={version}")


def current_map(spark: SparkSession, path: str, sizes: list[int], shards: int) -> int:
    """The version to use for slots of these sizes: the latest where it will do, else the next, which is stored."""
    version, old = latest_map(spark, path)
    if not version:
        version, old = 1, [k % shards for k in range(len(sizes))]
        store_map(spark, path, version, old)
    if len(old) != len(sizes):
        raise ValueError(f"the map under {path} has {len(old)} slots, not {len(sizes)}: slots are fixed")
    chosen = rebalance(old, sizes, shards)
    if chosen != old:
        version += 1
        store_map(spark, path, version, chosen)
    return version


def shard(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Law `bytes`: shards are near equal in size (UTF-8 bytes of the text, none for null, plus 1). slot is the row's place in its
    shard, from 0 without gaps; grown_shard is null. map_path: the folder of a map's versions, which is read, edited and added
    to; without it one of this run's own. Rows with a null or repeated id are spread over virtual slots (see slotted), so an id
    that many rows have is not in one shard; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    map_path = map_path or scratch_path(spark, "slot-map")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = materialise(slotted(materialise(rows, "records")), "slotted")
    parts = max(1, rows.count() // (SLOTS * PART_ROWS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("part")), F.lit(parts)).cast("int"))
    sums = rows.groupBy("virtual_slot", "_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    found = {r["virtual_slot"]: r["_bytes"] for r in sums.groupBy("virtual_slot").agg(F.sum("_bytes").alias("_bytes")).collect()}  # at most SLOTS rows
    version = current_map(spark, map_path, [found.get(k, 0) for k in range(SLOTS)], shards)
    table = spark.read.parquet(f"{map_path}/version={version}")
    # places: rows are numbered within their part of a virtual slot, parts one after another within their shard
    before = Window.partitionBy("map_shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(table, "virtual_slot").withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    starts = starts.select("virtual_slot", "_part", "map_shard", "_start")
    within = Window.partitionBy("virtual_slot", "_part").orderBy("doc_id", "size", "text_crc32")
    out = rows.withColumn("_row", F.row_number().over(within)).join(starts, ["virtual_slot", "_part"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("map_shard").cast("int").alias("shard"),
        (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )
