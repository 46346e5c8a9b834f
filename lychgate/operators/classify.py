"""Column classification: weighted signals from name, patterns and shape, exact in decimals.

All steps are projections over the profile (a row for each column); verdicts of an outside adjudicator are joined from the left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.name_rules import ACTIONS, DIRECT_IDENTIFIERS, NAME_RULES

SIGNAL = "struct<code: string, weight: decimal(12,8), detail: string>"


@dataclass(frozen=True)
class Thresholds:
    pii: float = 0.6
    review: float = 0.3
    strong_ratio: float = 0.6
    nudge: float = 0.15


def normalise(name: Column) -> Column:
    """camelCase and acronyms split by underscores, lower case, all else than letters and digits an underscore."""
    spaced = F.regexp_replace(F.regexp_replace(name, "(?<=[A-Z])(?=[A-Z][a-z])", "_"), "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]", "_"), r"\A_+|_+\z", "")


def name_rule(normalised: Column) -> Column:
    """struct(synonym, entity, category, weight) of the first rule that matches whole words of the name, else null."""
    framed = F.concat(F.lit("_"), normalised, F.lit("_"))
    found = []
    for synonyms, entity, category, weight in NAME_RULES:
        for s in synonyms:
            made = F.struct(F.lit(s).alias("synonym"), F.lit(entity).cast("string").alias("entity"), F.lit(category).alias("category"), F.lit(weight).cast("decimal(12,8)").alias("weight"))
            found.append(F.when(F.contains(framed, F.lit(f"_{s}_")), made))
    return F.coalesce(*found)


def dec(c: Column) -> Column:
    return c.cast("decimal(12,8)")


def signal(code: Column | str, weight: Column, detail: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(code).alias("code"), dec(weight).alias("weight"), as_col(detail).alias("detail")).cast(SIGNAL)


def classify(profiles: DataFrame, verdicts: DataFrame | None = None, limits: Thresholds = Thresholds(), verdict_col: str | None = None) -> DataFrame:  # noqa: B008
    """Adds category, score, signals, entity_type, recommended_action, needs_review, llm_adjudicated and llm_rationale.

    verdicts: (table, column, is_pii, confidence, rationale), at most one a column; one counts only where the score without
    it is in the review band, and moves it by at most limits.nudge. verdict_col: the same as a struct beside the profile.
    """
    p = profiles.withColumn("_rule", name_rule(normalise(F.col("column"))))
    p = p.withColumn("_ratio", dec(F.col("best_ratio")))
    named = F.col("_rule").isNotNull()
    entity0, hint0 = F.col("_rule.entity"), F.col("_rule.category")
    has, weak = F.col("best_entity").isNotNull(), (F.col("best_entity") == "DATE_OF_BIRTH") & ~F.coalesce(entity0 == "DATE_OF_BIRTH", F.lit(False))
    strong = has & ~weak & (F.col("_ratio") >= limits.strong_ratio)
    direct = F.when(F.col("best_entity").isin(*DIRECT_IDENTIFIERS), "PII_DIRECT").otherwise("PII_QUASI")
    p = p.withColumn("_entity", F.coalesce(entity0, F.when(strong, F.col("best_entity")))).withColumn("_hint", F.coalesce(hint0, F.when(strong, direct)))
    share = F.concat(F.round(F.col("_ratio") * 100, 0).cast("int").cast("string"), F.lit("% of sampled values"))
    by_name = F.when(named, signal(F.concat(F.lit("name:"), "_rule.synonym"), F.col("_rule.weight"), F.concat(F.lit("the name holds "), "_rule.synonym")))
    factor = F.when(weak, F.lit(0.15)).when(strong, F.lit(0.45)).otherwise(F.lit(0.2)).cast("decimal(4,2)")
    by_pattern = F.when(
        has,
        signal(
            F.when(weak, "pattern:date_weak").otherwise(F.concat(F.lit("pattern:"), "best_entity")),
            F.round(factor * F.col("_ratio"), 4),
            F.concat(share, F.when(weak, " are dates, but the name is not one of a birth date").otherwise(F.concat(F.lit(" are "), "best_entity"))),
        ),
    )
    card, kind = F.col("cardinality_ratio"), F.col("inferred_type")
    no_entity, no_hint = F.col("_entity").isNull(), F.col("_hint").isNull()
    shape = (
        F.when((card >= 0.95) & (kind == "text") & ~no_entity, signal("cardinality:unique", F.lit(0.15), "nearly all values differ"))
        .when((card >= 0.95) & no_entity & kind.isin("text", "numeric"), signal("cardinality:unique_unknown", F.lit(0.1), "nearly all values differ, with no known pattern"))
        .when((card <= 0.05) & F.coalesce(F.col("_hint") == "PII_QUASI", F.lit(False)), signal("cardinality:low_categorical", F.lit(0.1), "few values, as a demographic attribute has"))
        .when((card <= 0.02) & no_entity & no_hint, signal("cardinality:low", F.lit(-0.15), "very few values, as a code has"))
    )
    by_shape = F.when(F.col("non_null_count") >= 20, shape)
    by_type = F.when((kind == "numeric") & no_entity & no_hint, signal("type:numeric", F.lit(-0.1), "plain numbers"))
    p = p.withColumn("signals", F.filter(F.array(by_name, by_pattern, by_shape, by_type), lambda s: s.isNotNull()))
    zero = F.lit(0).cast("decimal(14,8)")
    clamp = lambda c: F.greatest(F.least(c, F.lit(1).cast("decimal(14,8)")), zero)
    p = p.withColumn("_score", clamp(F.aggregate("signals", zero, lambda acc, s: (acc + s["weight"]).cast("decimal(14,8)"))))
    band = lambda c: (c >= limits.review) & (c < limits.pii)
    if verdicts is not None:
        v = verdicts.select("table", "column", F.col("is_pii").alias("_is"), F.col("confidence").alias("_conf"), F.col("rationale").alias("_why"))
        p = p.join(v, ["table", "column"], "left")
    elif verdict_col is not None:
        v = F.col(verdict_col)
        p = p.withColumns({"_is": v["is_pii"], "_conf": v["confidence"], "_why": v["rationale"]}).drop(verdict_col)
    else:
        p = p.withColumns({"_is": F.lit(None).cast("boolean"), "_conf": F.lit(None).cast("double"), "_why": F.lit(None).cast("string")})
    heard = band(F.col("_score")) & F.col("_is").isNotNull()
    sign = F.when(F.col("_is"), 1.0).otherwise(-1.0)
    nudge = dec(F.lit(limits.nudge) * sign * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_conf", F.lit(0.0)))))
    said = signal("llm:adjudication", F.round(nudge, 4), F.concat(F.lit("adjudicator says "), F.when(F.col("_is"), "PII").otherwise("non-PII")))
    p = p.withColumn("llm_adjudicated", F.coalesce(heard, F.lit(False)))
    p = p.withColumn("signals", F.when(F.col("llm_adjudicated"), F.concat("signals", F.array(said))).otherwise(F.col("signals")))
    p = p.withColumn("_final", F.when(F.col("llm_adjudicated"), clamp((F.col("_score") + nudge).cast("decimal(14,8)"))).otherwise(F.col("_score")))
    p = p.withColumn("needs_review", band(F.col("_final")))
    kept = (F.col("needs_review") & F.col("_hint").isNotNull()) | ((F.col("_final") >= limits.pii * 0.5) & F.coalesce(F.col("_hint").isin("PII_QUASI", "SENSITIVE"), F.lit(False)))
    category = F.when(F.col("_final") >= limits.pii, F.coalesce("_hint", F.lit("PII_DIRECT"))).when(kept, F.col("_hint")).otherwise("NON_PII")
    p = p.withColumn("category", category)
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("category"))
    return (
        p.withColumn("score", F.round("_final", 4).cast("double"))
        .withColumn("entity_type", F.col("_entity"))
        .withColumn("recommended_action", action)
        .withColumn("llm_rationale", F.when(F.col("llm_adjudicated"), F.col("_why")))
        .drop("_rule", "_ratio", "_entity", "_hint", "_score", "_is", "_conf", "_why", "_final")
    )


def facts() -> Column:
    """What a profile says of a column, as JSON: its table and name and statistics, never values."""
    ratio = lambda c: F.round(c, 4).alias(c)
    told = ["table", "column", "inferred_type", "total_count", "distinct_count", ratio("cardinality_ratio"), "null_count", ratio("null_ratio"), "avg_length", ratio("digit_ratio"), "pattern_hits"]
    return F.to_json(F.struct(*told))


def for_review(classified: DataFrame) -> DataFrame:
    """What an adjudicator is told of the columns that need one: names and statistics."""
    return classified.where("needs_review").select("table", "column", facts().alias("summary"))


def roll_up(classified: DataFrame) -> DataFrame:
    """One row for each table: columns, pii_columns (direct or sensitive), needs_review, escalates, fails (if any column is PII)."""
    pii = F.col("category").isin("PII_DIRECT", "SENSITIVE")
    return classified.groupBy("table").agg(
        F.count("*").alias("columns"),
        F.count_if(pii).alias("pii_columns"),
        F.count_if("needs_review").alias("review_columns"),
        F.bool_or("needs_review").alias("escalates"),
        F.bool_or(pii).alias("fails"),
    )
