"""WARC archives with revisit records.

Headers (id, payload digest, length) are shuffled by digest and meet the least id of each repeated payload; pages then go
to archives of about ARCHIVE_BYTES with fresh headers, repeated payloads as revisit records without a body. Archives are
written by Spark's text writer (a record is UTF-8 text) and read back whole files at a time by content length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path

ARCHIVE_BYTES = 16_000_000
LEAST_BYTES = 100
#: Fixed value: the profile of a revisit to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEW_LINE = "\r\n"


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds payload_bytes, payload_digest, original (the page that a revisit refers to, else null) to (page_id, url, payload).

    Only ids, digests and lengths are shuffled by digest; payloads meet the outcome by page_id, which no payload makes hot.
    """
    whole = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    heads = materialise(whole.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest"), "heads")
    repeated = heads.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")
    again = heads.join(materialise(repeated, "repeated"), "payload_digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("original"))).distinct()
    w, a = whole.alias("w"), materialise(again, "revisits").alias("a")
    return w.join(a, F.col("w.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("w.payload_digest") == F.col("a.payload_digest")), "left").select("w.*", "a.original")


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record(date: str) -> Column:
    """One record as text, but for the last line break, which the writer adds."""
    revisit = F.col("original").isNotNull()
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", urn(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        ("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, urn(F.col("original")))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    ]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(NEW_LINE))).otherwise("") for k, v in fields]
    return F.concat(F.lit("WARC/1.1" + NEW_LINE), *lines, F.lit(NEW_LINE), F.when(revisit, "").otherwise(F.col("payload")), F.lit(NEW_LINE))


def write(resolved: DataFrame, path: str, records_per_file: int, date: str = "2024-01-01T00:00:00Z") -> None:
    out = resolved.select(record(date).alias("value")).write.option("lineSep", NEW_LINE).option("maxRecordsPerFile", records_per_file)
    out.text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record, by content length: a body may hold anything."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split(NEW_LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {first[:40]!r}")
        head = dict(line.split(": ", 1) for line in lines)
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of all archives under path: page_id, url, record_type, refers_to, payload_digest, payload_bytes, stored_digest
    (of the body as read; null for revisits) and, if asked for, payload."""
    import hashlib

    def page(name: str | None) -> int | None:
        digits = (name or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for head, body in parse(data):
                    kind = head["WARC-Type"]
                    own = hashlib.sha256(body).hexdigest() if kind == "response" else None
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
                    rows.append((page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, page(head.get("WARC-Refers-To")), digest, n, own, len(body), *([body] if with_payload else [])))
                cols = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "stored_digest", "stored_bytes", *["payload"] * with_payload]
                out = pd.DataFrame(rows, columns=cols)
                for c in ("page_id", "refers_to"):
                    out[c] = pd.array([r[cols.index(c)] for r in rows], "Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, stored_digest string, stored_bytes long"
    return files.mapInPandas(run, schema + ", payload binary" * with_payload)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as deduplicated archives and reads them back.

    Per row: page_id, payload_bytes, payload_digest, record_type, refers_to. Digest and length of a response are those of the
    body as read back; a revisit's are taken from the response it refers to. A null html is an empty payload; payloads of
    fewer than least_bytes bytes are never revisited. Rows that repeat the least page_id of a payload are responses too; a
    null page_id is larger than any other. Other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows, total = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    write(resolve(named, least_bytes), path, max(1, ARCHIVE_BYTES * max(1, rows) // max(1, total + 500 * rows)))
    back = materialise(read(spark, path), "headers")
    originals = back.where("record_type = 'response'").groupBy(F.col("page_id").alias("original"), F.col("payload_digest").alias("digest"))
    originals = originals.agg(F.first("stored_bytes").alias("original_bytes"), F.first("stored_digest").alias("original_digest"))
    revisits = back.where("record_type = 'revisit'")
    kept = revisits.join(originals, (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("digest")), "left")
    out = [F.col("page_id")]
    responses = back.where("record_type = 'response'").select(*out, F.col("stored_bytes").alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(kept.select(*out, F.col("original_bytes").alias("payload_bytes"), F.col("original_digest").alias("payload_digest"), "record_type", "refers_to"))
