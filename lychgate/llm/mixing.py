"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled by a hash; every pass over a source queues each of them once more, with the virtual finish
time (words of the source queued so far) / (target of the source). All queued copies are sorted by finish time over the whole
corpus and taken until the budget is used. Running sums are taken in two steps - sums of hash or time buckets, then rows
within a bucket - so that neither a hot source nor the whole queue is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
#: Bits of the shuffle hash (of 60, the high ones) that make buckets within a source, and of buckets of a unit of finish time
#: within the queue: ten, and more where a bucket would have more than BUCKET_ROWS rows.
BUCKET_BITS, BUCKET_ROWS = 10, 200_000
#: Parts into which equal rows are dealt to be numbered: SALTS at least, and more where rows are many.
SALTS = 256


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}\\z", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def text_hash(text: Column) -> Column:
    """Tells texts apart in ties; empty for null."""
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, share: float = 1.0) -> DataFrame:
    """source, source_size, target for the table (source, source_size) of all sources.

    Sources in code-point order, null last, weigh by turns; they share `share` of all words by weight; no target exceeds
    `repeats` times its source's size, and what is over is shared anew. In order of size / weight the capped sources come
    first, so one running sum finds them all.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    w = sizes.withColumn("_n", F.row_number().over(order) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("_cap", F.col("source_size").cast("double") * repeats)
    ranked = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    whole = Window.partitionBy()
    w = w.withColumn("_caps", F.sum("_cap").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    w = w.withColumn("_gone", F.sum("_w").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    w = w.withColumn("_all", F.sum("source_size").over(whole) * share).withColumn("_ws", F.sum("_w").over(whole))
    # level: words a unit of weight gets once this source and all before it are capped
    before_level = (F.col("_all") - (F.col("_caps") - F.col("_cap"))) / (F.col("_ws") - (F.col("_gone") - F.col("_w")))
    w = w.withColumn("_level", before_level).withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("_w"))
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), F.col("_n"), F.col("_level")))).over(whole)["_level"]
    return w.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("_w")).alias("target"))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of value within keys, in order of (bucket, *order); buckets are summed first."""
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*keys, bucket, "_base")
    joined = df.withColumn("_own", F.sum(value).over(within)).alias("l").join(base.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, bucket]])
    return joined.select("l.*", (F.col("r._base") + F.col("l._own")).alias(name)).drop("_own")


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """rows (_key, _part, ...) with _copy, from 0 among rows of one key; which of them gets which number makes no difference."""
    again = materialise(rows.groupBy("_key").count().where("count > 1").select("_key"), "again")
    if again.isEmpty():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    sums = rows.join(again, "_key").groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_key", "_part", "_base")
    within = Window.partitionBy("_key", "_part").orderBy("doc_id")
    copies = rows.join(again, "_key").withColumn("_row", F.row_number().over(within)).join(sums, ["_key", "_part"])
    copies = copies.select(*rows.columns, (F.col("_base") + F.col("_row") - 1).alias("_copy"))
    return rows.join(again, "_key", "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(copies)


def slot_of(finish: Column, bits: int) -> Column:
    """Buckets of finish times in their order: even ones up to 2, where nearly all of the mix is, and from there on ever wider ones."""
    late = F.floor(F.log2(finish) * 2 ** (bits - 4)) + 2 ** (bits + 1)
    return F.when(finish < 2, F.floor(finish * 2**bits)).otherwise(late).cast("long")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken.

    size counts words ([^\\x20\\x09-\\x0D]+, 0 for null or empty text), taken is size times the copies in the mix, at most
    `repeats`. Rows with a null source are one source, which comes last. Repeated rows are documents of their own, told apart by a
    number; ties are broken by id, size and the text's hash, so reruns agree. All copies are queued, so the budget is used to the
    last document however large documents are. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_hash(F.col(text_col)).alias("_text"))
    made = lambda *more: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "_text", F.lit(str(seed)), *more)), 1, 15), 16, 10).cast("long")
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_key", made()), "sizes")
    many = rows.count()
    bits = max(BUCKET_BITS, (many // BUCKET_ROWS).bit_length())
    parts = max(SALTS, many // BUCKET_ROWS)
    rows = numbered(rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int")).drop("_id"), parts).drop("_part")
    rows = rows.withColumn("_key", F.when(F.col("_copy") == 0, F.col("_key")).otherwise(made(F.col("_copy").cast("string")))).drop("_copy")
    goal = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share), "targets")
    keyed = rows.withColumn("_bucket", F.shiftright("_key", 60 - bits).cast("int"))
    queued = running(keyed, ["source"], "_bucket", ["_key", "doc_id", "size", "_text"], "size", "_queued").alias("q")
    goals = goal.alias("g")
    queued = queued.join(goals, F.col("q.source").eqNullSafe(F.col("g.source"))).select("q.doc_id", "q.source", "q.size", "q._key", "q._text", "q._queued", "g.source_size", "g.target")
    queued = materialise(queued, "queue")
    copies = queued.where("size > 0 AND target > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("_finish", (F.col("_pass") * F.col("source_size") + F.col("_queued")) / F.col("target"))
    copies = copies.withColumn("_slot", slot_of(F.col("_finish"), bits))
    order = ["_finish", "source", "_key", "doc_id", "_text", "size"]
    taken = running(copies, [], "_slot", order, "size", "_total")
    words = goal.agg(F.sum("source_size")).first()[0] or 0  # one number
    taken = taken.where(F.col("_total") <= words * share + 0.5)
    # copies of a row are told apart by nothing but the pass, so a row's copies are counted by its place in its queue
    counts = taken.groupBy("source", "_queued", "doc_id", "_key", "_text").agg(F.count("*").alias("_copies"))
    q, c = queued.alias("q"), counts.alias("c")
    same = [F.col(f"q.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("source", "_queued", "doc_id", "_key", "_text")] + [F.col("q.size") > 0]
    out = q.join(c, same, "left")
    return out.select("q.doc_id", "q.size", "q.source_size", "q.target", (F.coalesce("c._copies", F.lit(0)) * F.col("q.size")).alias("taken"), F.col("q._text").alias("text_hash"), F.col("q.source").alias("source"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy taken; order of columns as in docs."""
    counts = mix(docs, **how).where("size > 0")
    # repeated rows share these keys: what they took together goes to one of them
    copies = counts.groupBy("doc_id", "text_hash", "source").agg((F.sum("taken") / F.first("size")).cast("int").alias("copies"), F.count("*").alias("rows"))
    copies = copies.where("copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no column clashes with ours
    same = [F.col("row.doc_id").eqNullSafe(F.col("doc_id")), text_hash(F.col("row.text")).eqNullSafe(F.col("text_hash")), F.col("row.source").eqNullSafe(F.col("source"))]
    found = rows.join(copies, same)
    once = found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["doc_id", "text_hash", "source"]))
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
