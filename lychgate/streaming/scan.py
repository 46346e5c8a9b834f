"""The gate on streams: the same row-local expressions, so no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import detect, policy, redact
from ..operators.audit import AuditLog, events, summary
from ..operators.trail import Trail


def guarded_stream(spark: SparkSession, path: str, schema: StructType, text_col: str = "text", rules: policy.Policy | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A file stream with findings, action and the text that may leave: null where it is blocked."""
    df = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    df = policy.decide(redact.redact(detect.scan(df, text_col), text_col), rules or policy.Policy())
    released = F.when(F.col("action") == "ALLOW", F.col(text_col)).when(F.col("action") == "REDACT", F.col("redacted"))
    return df.withColumn("released", released)


def write_with_audit(df: DataFrame, out: str, checkpoint: str, audit: Callable[[DataFrame, int], None], keep: list[str]) -> StreamingQuery:
    """Writes what may leave as Parquet, one folder a batch so that a repeated batch replaces itself, then hands the batch to audit."""

    def batch(part: DataFrame, n: int) -> None:
        part = part.persist()
        part.where("released IS NOT NULL").select(*keep, "released", "action").write.mode("overwrite").parquet(f"{out}/batch={n}")
        audit(part, n)
        part.unpersist()

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited(log: AuditLog, stream: str) -> Callable[[DataFrame, int], None]:
    """For write_with_audit: sums of each batch as events. A batch that is run again, after a failure, is not recorded twice."""

    def record(part: DataFrame, n: int) -> None:
        log.append(summary(part, f"{stream}#{n}"), batch=f"{stream}#{n}")

    return record


def write_committed(df: DataFrame, out: str, checkpoint: str, trail: Trail, stream: str, keep: list[str], id_col: str = "doc_id") -> StreamingQuery:
    """Writes what may leave and an event for every row, and publishes both by one record in the trail's log.

    A batch is a folder of released rows and one of events; both replace what a failed run of the batch left. Neither counts before
    the log has the batch's root, which is one line, written whole or not at all. Read what counts with committed().
    """

    def batch(part: DataFrame, n: int) -> None:
        part = part.persist()
        try:
            released = part.where("released IS NOT NULL").select(*keep, "released", "action")
            released.write.mode("overwrite").parquet(f"{out}/number={n}")
            trail.append(events(part, id_col), stream, n)
        finally:
            part.unpersist()

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, trail: Trail, stream: str) -> DataFrame:
    """Released rows of the batches that the trail has recorded."""
    numbers = trail.recorded(spark).where(F.col("stream") == stream).select("number")
    return spark.read.parquet(out).withColumn("number", F.col("number").cast("long")).join(numbers, "number", "left_semi")
