"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are numbers; trees grown on a bounded sample of labelled rows split them; every path from a root is
a rule, a conjunction of comparisons; lasso logistic regression gives most rules the weight 0; the rest are compiled into one
Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified, materialise, text_slices

STATISTICS = (
    "log_words", "word_length", "distinct_words", "top_word", "top_line", "distinct_lines",
    "upper", "digits", "symbols", "pipes", "bangs", "punctuation", "longest_word", "line_words", "symbol_words",
)
#: Labelled rows that the trees and the weights are fitted on, at most; taken by a hash of doc_id, so they are a fair sample.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 24, 4
LASSO = 0.0015
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0 letters and other bytes, 1 upper case, 2 digits, 3 space, 4 punctuation, 5 symbols
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?!"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all zero for null and for texts without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    _, upper, digits, space, punctuation, symbols = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6).tolist()
    shown = len(data) - space
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    return [
        math.log1p(n),
        shown / n,
        len(counts) / n,
        max(counts.values()) / n,
        max(line_counts.values()) / len(lines),
        len(line_counts) / len(lines),
        upper / shown,
        digits / shown,
        symbols / shown,
        data.count(b"|") / n,
        data.count(b"!!") / n,
        punctuation / shown,
        math.log1p(max(map(len, counts))),
        math.log1p(n / len(lines)),
        sum(c for w, c in counts.items() if w[-1:] in b"#$%&*|") / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """doc_id, uid (name_col, a long that is never null; 0 without one) and STATISTICS for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_slices(batches, "t"):
            x = np.array([statistics(t) for t in pdf["t"]], float).reshape(len(pdf), len(STATISTICS))
            out = pd.DataFrame(x, columns=list(STATISTICS))
            out.insert(0, "uid", pdf["uid"].to_numpy())
            out.insert(0, "doc_id", pd.array([None if x is None else int(x) for x in pdf["id"]], "Int64"))
            yield out

    uid = F.lit(0).cast("long") if name_col is None else F.col(name_col)
    read = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("t"), uid.alias("uid"))
    return read.mapInPandas(run, "doc_id long, uid long, " + ", ".join(f"{s} double" for s in STATISTICS))


def held_out(doc_id: Column) -> Column:
    """Every fifth row by the checksum of its id as text; a null id is never held out, nor has it a label."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Lower bounds are exclusive, upper bounds inclusive, as the trees split."""

    bounds: tuple[tuple[int, float, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, high in self.bounds:
            out &= (x[:, k] > low) & (x[:, k] <= high)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, low, high in self.bounds:
            if low > -math.inf:
                out = out & (F.col(STATISTICS[k]) > low)
            if high < math.inf:
                out = out & (F.col(STATISTICS[k]) <= high)
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The model as one column expression over STATISTICS."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(model) -> list[Rule]:
    """All paths of a forest's trees, inner ones included, without doubles."""
    found: dict[tuple, Rule] = {}

    def walk(node, bounds: dict[int, tuple[float, float]]) -> None:
        if bounds:
            key = tuple((k, *bounds[k]) for k in sorted(bounds))
            found.setdefault(key, Rule(key))
        if node.subtreeDepth() > 0:
            k, at = node.split().featureIndex(), node.split().threshold()
            low, high = bounds.get(k, (-math.inf, math.inf))
            walk(node.leftChild(), bounds | {k: (low, min(high, at))})
            walk(node.rightChild(), bounds | {k: (max(low, at), high)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found.values())


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> RuleModel:
    """Rules and weights from (doc_id, quality, STATISTICS). With one kind of label or none, the share of label 1 (0.5) for all."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = labelled.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)  # bounded: fitted in a single partition
    chosen = materialise(chosen.withColumn("label", F.col("quality").cast("double")).coalesce(1), "sample")
    n, ones = chosen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0.0, float(n)):
        p = min(max(ones / n if n else 0.5, 0.001), 0.999)
        return RuleModel(math.log(p / (1 - p)), ())
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(chosen).select("label", "x").coalesce(1)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=max(1, n // 2000), subsamplingRate=0.7)
    rules = tree_rules(forest.fit(data))
    wide = chosen.select("label", *[r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    wide = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(wide).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60)
    model = lasso.fit(materialise(wide, "rules").coalesce(1))
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """doc_id, uid, held_out, score and predicted of every row, by a model of the labelled rows that aren't held out."""
    rows = materialise(with_statistics(docs, id_col, text_col, name_col), "statistics")
    known = labels.select("doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    model = fit(rows.join(known, "doc_id"))
    out = rows.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", model.score())
    return out.select("doc_id", "uid", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score (that its label is 1), predicted (1 if score >= THRESHOLD).

    Learns from labelled rows that aren't held out, on text statistics alone. Null and empty texts have statistics of zero
    and are scored as such; repeated rows are scored alike; several labels of a document count once each; null labels
    don't count; other columns are not read; an empty table gives an empty result.
    """
    return scored(docs, labels, id_col, text_col).drop("uid")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with all their columns.

    Every text is judged by itself, one without a doc_id or with another's too; repeated rows stay or go together.
    """
    named = identified(docs)
    verdict = scored(named, labels, "row.doc_id", "row.text", "uid").groupBy("uid").agg(F.max("predicted").alias("ok")).where("ok = 1")
    return named.join(verdict, "uid", "left_semi").select("row.*")
