"""What may leave: ALLOW, REDACT or BLOCK, with reasons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default lists.
BLOCK = ("CREDIT_CARD", "SG_NRIC", "HK_HKID", "JP_MY_NUMBER", "AU_TFN", "AU_MEDICARE", "US_SSN", "PASSPORT")
REDACT = ("EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN", "IP_ADDRESS", "DATE_OF_BIRTH", "PERSON_NAME", "ADDRESS", "AU_ABN", "GENERIC_ID")


@dataclass(frozen=True)
class Policy:
    block: tuple[str, ...] = field(default=BLOCK)
    redact: tuple[str, ...] = field(default=REDACT)
    least_confidence: float = 0.5
    block_at_or_above: int = 1


def decide(df: DataFrame, policy: Policy = Policy(), findings_col: str = "findings") -> DataFrame:  # noqa: B008
    """Adds action, reasons (high severity first), findings_considered and escalates.

    Labels to block count whatever their confidence; labels to redact from least_confidence on. A label on both lists counts twice.
    """
    findings = F.col(findings_col)
    among = lambda f, names: f["entity_type"].isin(*names) if names else F.lit(False)
    df = df.withColumn("_block", F.filter(findings, lambda f: among(f, policy.block)))
    df = df.withColumn("_redact", F.filter(findings, lambda f: among(f, policy.redact) & (f["confidence"] >= policy.least_confidence)))
    action = F.when(F.size("_block") >= policy.block_at_or_above, "BLOCK").when(F.size("_redact") > 0, "REDACT").otherwise("ALLOW")

    def reason(severity: str, rank: int, what: str):
        def made(f: Column, i: Column) -> Column:
            proof = F.when(f["validated"], ", checksum-validated").otherwise("")
            detail = F.concat(F.lit("characters "), f["start"].cast("string"), F.lit("-"), f["end"].cast("string"), F.lit(" by "), f["recognizer"], proof)
            return F.struct(F.lit(rank).alias("rank"), F.concat(f["entity_type"], F.lit(what)).alias("summary"), i.alias("i"), F.lit(severity).alias("severity"), detail.alias("detail"))

        return made

    listed = F.array_sort(F.concat(F.transform("_block", reason("HIGH", 0, " must not leave")), F.transform("_redact", reason("MEDIUM", 1, " must be redacted"))))
    shown = F.transform(listed, lambda r: F.struct(r["severity"].alias("severity"), r["summary"].alias("summary"), r["detail"].alias("detail")))
    clear = F.array(F.struct(F.lit("LOW").alias("severity"), F.lit("nothing to act on").alias("summary"), F.lit("no finding is on a list").alias("detail")))
    return (
        df.withColumn("action", action)
        .withColumn("findings_considered", F.size("_block") + F.size("_redact"))
        .withColumn("reasons", F.when((F.col("action") == "ALLOW") & (F.col("findings_considered") == 0), clear).otherwise(shown))
        .withColumn("escalates", F.col("action") == "BLOCK")
        .drop("_block", "_redact")
    )
