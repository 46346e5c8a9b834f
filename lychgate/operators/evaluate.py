"""Quality against labelled cases: multisets of (case, label, text)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, detect, policy, profile

KEYS = ["case_id", "label", "text"]


def precision_recall(expected: DataFrame, predicted: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
    """One row: tp, fp, fn, precision, recall. Both frames hold case_id, label, text, a row for each occurrence.

    An occurrence counts as often as both sides have it. Without predictions the precision is 0, without expectations the recall.
    """
    if labels is not None:
        expected, predicted = (x.where(F.col("label").isin(*labels)) for x in (expected, predicted))
    e = expected.groupBy(KEYS).agg(F.count("*").alias("e"))
    p = predicted.groupBy(KEYS).agg(F.count("*").alias("p"))
    both = e.join(p, KEYS, "full_outer").na.fill(0, ["e", "p"])
    sums = both.agg(F.coalesce(F.sum(F.least("e", "p")), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("_p"), F.coalesce(F.sum("e"), F.lit(0)).alias("_e"))
    share = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(F.lit(0.0))
    return sums.select("tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_e") - F.col("tp")).alias("fn"), share("_p").alias("precision"), share("_e").alias("recall"))


def scanned(cases: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """What a scan of the cases reports: case_id, label, text, a row for each finding. how: see detect.scan."""
    found = detect.each(detect.scan(cases.select("case_id", text_col), text_col, **how), "findings", "case_id")
    return found.select("case_id", F.col("f.entity_type").alias("label"), F.col("f.text").alias("text"))


def compared(cases: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row for each case: case_id, positive, tp, fp, fn, missed, spurious (sorted arrays of label and text, repeats kept).

    cases: case_id (once each) and expected, an array of structs of label and text; null or empty is a negative case. predicted: as
    scanned() gives it; what it says of other cases is left out.
    """
    own = cases.select("case_id", F.coalesce(F.size("expected") > 0, F.lit(False)).alias("positive"))
    e = cases.select("case_id", F.explode("expected").alias("x")).groupBy("case_id", "x.label", "x.text").agg(F.count("*").alias("e"))
    p = predicted.groupBy(KEYS).agg(F.count("*").alias("p"))
    both = e.join(p, KEYS, "full_outer").na.fill(0, ["e", "p"])
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    times = lambda n: F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.struct("label", "text"), n.cast("int")))))
    sums = both.groupBy("case_id").agg(
        F.sum(F.least("e", "p")).alias("tp"), F.sum(more("p", "e")).alias("fp"), F.sum(more("e", "p")).alias("fn"),
        times(more("e", "p")).alias("missed"), times(more("p", "e")).alias("spurious"),
    )
    return own.join(sums, "case_id", "left").na.fill(0, ["tp", "fp", "fn"])


def _over(part: str, rest: str, otherwise: Column) -> Column:
    whole = F.col(part) + F.col(rest)
    return F.when(whole > 0, F.col(part) / whole).otherwise(otherwise)


def text_quality(cases: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: cases, positive, tp, fp, fn, precision, recall over every label of a corpus; frames as in compared().

    A corpus has to be able to fail: without a positive case the recall is 0, without a negative one the precision is 0. Else the
    precision without predictions is 1.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = compared(cases, predicted).agg(F.count("*").alias("cases"), F.count_if("positive").alias("positive"), total("tp"), total("fp"), total("fn"))
    precision = F.when(F.col("positive") == F.col("cases"), 0.0).otherwise(_over("tp", "fp", F.lit(1.0)))
    recall = F.when(F.col("positive") == 0, 0.0).otherwise(_over("tp", "fn", F.lit(1.0)))
    return sums.withColumn("precision", precision).withColumn("recall", recall)


def block_recall(cases: DataFrame, predicted: DataFrame, labels: Iterable[str] = policy.BLOCK) -> DataFrame:
    """One row: tp, fn, recall of the labels that a policy blocks, so that a good average can't hide a miss among them. Without one in
    the cases the recall is 0."""
    names = list(labels)
    wanted = cases.withColumn("expected", F.filter("expected", lambda x: x["label"].isin(*names) if names else F.lit(False)))
    sums = compared(wanted, predicted.where(F.col("label").isin(*names))).agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"))
    return sums.withColumn("recall", _over("tp", "fn", F.lit(0.0)))


def column_accuracy(expected: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: expected, correct, accuracy. A column that was not classified is a failure, and so is a corpus that expects nothing
    (accuracy 0). Where expected names tables, a column is that of its table; else a name that several tables have must be right in all."""
    keys = [c for c in ("table", "column") if c in expected.columns]
    found = classified.groupBy(*keys).agg(F.when(F.count_distinct("category") == 1, F.first("category")).alias("category"))
    both = expected.select(*keys, F.col("category").alias("want")).join(found, keys, "left")
    right = F.count_if(F.coalesce(F.col("category") == F.col("want"), F.lit(False)))
    return both.agg(F.count("*").alias("expected"), right.alias("correct")).withColumn("accuracy", F.when(F.col("expected") > 0, F.col("correct") / F.col("expected")).otherwise(F.lit(0.0)))


# The least that a release must reach.
BARS = {"precision_en": 0.90, "recall_en": 0.85, "precision_ja": 0.90, "recall_ja": 0.85, "columns": 0.85, "block_recall": 0.99}


def gate(measured: dict[str, float], bars: dict[str, float] = BARS) -> list[str]:
    """What falls short, as sentences; nothing if all is well. A bar without a measure, or a measure without a bar, falls short."""
    out = [f"{k}: no measure" for k in bars if k not in measured] + [f"{k}: no bar" for k in measured if k not in bars]
    return out + [f"{k}: {measured[k]:.4f} is below {v}" for k, v in bars.items() if k in measured and measured[k] < v]


def measure(corpora: Mapping[str, DataFrame], columns: DataFrame, classified: DataFrame, labels: Iterable[str] = policy.BLOCK, **how) -> dict[str, float]:
    """What gate() holds against its bars: precision and recall of each corpus by name (en, ja), column accuracy, block recall of all.

    corpora: case_id, text, expected. Every frame is reduced to one row before it comes to the driver.
    """
    out, whole, said = {}, None, None
    for name, cases in corpora.items():
        found = scanned(cases, **how)
        row = text_quality(cases, found).first()
        out |= {f"precision_{name}": row.precision, f"recall_{name}": row.recall}
        # one case_id may stand in several corpora
        apart = lambda df, name=name: df.withColumn("case_id", F.concat(F.lit(f"{name}:"), F.col("case_id").cast("string")))
        part = apart(cases.select("case_id", "expected"))
        whole, said = (part, apart(found)) if whole is None else (whole.unionByName(part), said.unionByName(apart(found)))
    out["columns"] = column_accuracy(columns, classified).first().accuracy
    out["block_recall"] = block_recall(whole, said, labels).first().recall if whole is not None else 0.0
    return out


CASES = "case_id string, text string, expected array<struct<label: string, text: string>>"


def run(spark: SparkSession, folder: str, **how) -> tuple[dict[str, float], list[str]]:
    """The measures of a folder's corpora and what falls short of the bars: en.jsonl and ja.jsonl (CASES), columns.csv and, what its
    columns are, columns.jsonl (table, column, category)."""
    corpora = {name: spark.read.schema(CASES).json(f"{folder}/{name}.jsonl") for name in ("en", "ja")}
    table = spark.read.csv(f"{folder}/columns.csv", header=True)
    expected = spark.read.schema("table string, column string, category string").json(f"{folder}/columns.jsonl")
    classified = classify.classify(profile.profile(profile.long_form(table, "columns", sample=None), pattern_sample=None, type_sample=None))
    measured = measure(corpora, expected, classified, **how)
    return measured, gate(measured)


def path_coverage(ner: str | None = None, adjudicator: str | None = None, ocr: str | None = None) -> list[tuple[str, str, str]]:
    """(path, binding, status) of every way to a finding. Only the patterns have labelled cases, so a path that is bound to an engine is
    UNMEASURED rather than passed over, and one without is inactive."""
    paths = [("patterns", "built in", "MEASURED: every finding in the labelled texts counts")]
    for path, bound, lacks in (
        ("entity engine", ner, "no labelled names or addresses"),
        ("column adjudicator", adjudicator, "no labelled verdicts"),
        ("OCR and image redaction", ocr, "no labelled boxes"),
    ):
        paths.append((path, bound or "none", f"UNMEASURED: {lacks}" if bound else "inactive: adds nothing"))
    return paths
