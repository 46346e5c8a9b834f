"""Redaction of findings: tag, mask, salted hash or removal, by label."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, chunks, cut

STRATEGIES = ("tag", "mask", "hash", "remove")
KEEP_LAST, MASK_CHAR, HASH_CHARS = 4, "*", 12
DEFAULT_SALT = "lychgate"  # tokens join only with those of the same salt: callers that have one give it
DEFAULTS = {"CREDIT_CARD": "mask", "IBAN": "mask"}


def replacement(finding: Column, strategy: str, salt: str = DEFAULT_SALT) -> Column:
    label, text = finding["entity_type"], finding["text"]
    if strategy == "tag":
        return F.concat(F.lit("<"), label, F.lit(">"))
    if strategy == "mask":
        n = F.length(text)
        return F.concat(F.repeat(F.lit(MASK_CHAR), F.when(n > KEEP_LAST, n - KEEP_LAST).otherwise(n)), F.when(n > KEEP_LAST, F.right(text, F.lit(KEEP_LAST))).otherwise(""))
    if strategy == "hash":
        return F.concat(F.lit("<"), label, F.lit("#"), F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, HASH_CHARS), F.lit(">"))
    if strategy == "remove":
        return F.lit("")
    raise ValueError(f"unknown strategy {strategy!r}; use one of {', '.join(STRATEGIES)}")


def redact(df: DataFrame, text_col: str = "text", findings_col: str = "findings", strategies: Mapping[str, str] = DEFAULTS, default: str = "tag", salt: str = DEFAULT_SALT) -> DataFrame:
    """Adds redacted and applied (the findings with strategy and replacement, in text order).

    The text between findings is kept and joined with the replacements, so the work is linear in the text. All findings are
    replaced, whatever a policy says of them; they must not overlap. A null text stays null.
    """
    text, findings = F.col(text_col), F.col(findings_col)

    def chosen(f: Column) -> tuple[Column, Column]:
        own = [(f["entity_type"] == label, strategy) for label, strategy in strategies.items()]
        name = F.coalesce(*[F.when(test, F.lit(strategy)) for test, strategy in own], F.lit(default))
        by = F.coalesce(*[F.when(test, replacement(f, strategy, salt)) for test, strategy in own], replacement(f, default, salt))
        return name, by

    applied = F.transform(findings, lambda f: F.struct(f["entity_type"].alias("entity_type"), f["start"].alias("start"), f["end"].alias("end"), chosen(f)[0].alias("strategy"), chosen(f)[1].alias("replacement")))

    def join(both: Column) -> Column:
        done, pieces = both["applied"], both["pieces"]
        before = lambda i: F.coalesce(F.get(done, i - 1)["end"], F.lit(0))
        parts = F.transform(done, lambda a, i: F.concat(cut(pieces, before(i), a["start"]), a["replacement"]))
        return F.concat(F.array_join(parts, ""), cut(pieces, before(F.size(done)), both["size"]))

    joined = bound(F.struct(F.col("applied").alias("applied"), chunks(text).alias("pieces"), F.length(text).alias("size")), join)
    return df.withColumn("applied", applied).withColumn("redacted", F.when(F.size("applied") == 0, text).otherwise(joined))
