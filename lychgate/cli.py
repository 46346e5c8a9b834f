"""Command line: python -m lychgate.cli scan-text|redact-text|decide SOURCE --text-col ...; one text by --text, a .txt file or -.
classify-columns SOURCE for tables; scan-image|redact-image FOLDER --ocr package.module:make for images; evaluate FOLDER for the gate of
a release over labelled cases (see operators/evaluate.run), which ends with 4 where a bar is missed.

Engines are given as package.module:make, where make() builds one in a worker: --engine takes a text and --adjudicator a table, a
column and its summary (both return the answer as text), --ocr a PNG file (returns words with their boxes).

Exit codes: 0 allowed or clean, 3 something to redact, 4 blocked (or personal columns with --fail-on-pii), 2 refused.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as config
from .operators import audit, classify, detect, engines, evaluate, images, policy, profile, redact
from .plans.recognizers import select
from .sources import router

CODES = {"ALLOW": 0, "REDACT": 3, "BLOCK": 4}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lychgate", description=__doc__)
    p.add_argument("command", choices=["scan-text", "redact-text", "decide", "classify-columns", "scan-image", "redact-image", "evaluate"])
    p.add_argument("source", nargs="?", help="a table, a database or a folder of images; - for one text from standard input")
    p.add_argument("--text", help="one text instead of a source")
    p.add_argument("--table", help="a table of a database")
    p.add_argument("--text-col", default="text")
    p.add_argument("--config")
    p.add_argument("--out", help="write the result there; else it is printed as JSON lines")
    p.add_argument("--format", choices=["parquet", "json", "text"], default="parquet", help="of --out; text is that of redact-text alone")
    p.add_argument("--sample", type=int, help="values read of each column")
    p.add_argument("--fail-on-pii", action="store_true")
    for name in ("engine", "adjudicator", "ocr"):
        p.add_argument(f"--{name}", type=hook, metavar="PACKAGE.MODULE:MAKE")
    return p


def hook(name: str) -> Callable:
    """The function that package.module:function names."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"{name!r} names no function") from e


def documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.text is not None or args.source in (None, "-") or args.source.lower().endswith(".txt"):
        one = Path(args.source).read_text(encoding="utf-8") if args.text is None and args.source not in (None, "-") else None
        text = args.text if args.text is not None else sys.stdin.read() if one is None else one
        return spark.createDataFrame([(args.source or "text", text)], f"source string, `{args.text_col}` string")
    (_, df), *more = router.open_source(spark, args.source, args.table).items()
    if more:
        raise ValueError("name one table")
    return df


def emit(df: DataFrame, out: str | None, fmt: str = "parquet") -> None:
    if out and fmt == "text":
        df.select("redacted").write.mode("errorifexists").text(out)
    elif out:
        df.write.mode("errorifexists").format(fmt).save(out)
    else:
        for row in df.toJSON().toLocalIterator():
            print(row)


def classify_columns(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> DataFrame:
    limit = s.sample_limit if args.sample is None else args.sample
    long = router.sampled_source(spark, args.source, limit, args.table)
    profiles = profile.profile(long, select(s.jurisdictions))
    return engines.adjudicate(profiles, args.adjudicator, s.thresholds) if args.adjudicator else classify.classify(profiles, limits=s.thresholds)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df, computed and written once, for all that read it here: exit code, audit and output tell of the same findings, and an engine is
    asked once a text. It lies in the folder that spark.checkpoint.dir names; where none is named, and driver and executors are one
    machine, in a folder of its own. It goes when it was read."""
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(named or f'file://{tempfile.gettempdir()}').rstrip('/')}/lychgate-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def record(s: config.Settings, events: Callable[[], list]) -> None:
    if s.audit_log:
        audit.AuditLog(s.audit_log).append(events())


def run(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> int:
    if args.format == "text" and args.command != "redact-text":
        raise ValueError("only redact-text writes text")
    chosen = select(s.jurisdictions)
    if args.command == "classify-columns":
        if not args.source:
            raise ValueError("name a source")
        with written(classify_columns(spark, args, s)) as out:
            record(s, lambda: audit.column_events(out, router.safe_address(args.source)))
            emit(out, args.out, args.format)
            fails = out.where(F.col("category").isin("PII_DIRECT", "SENSITIVE")).limit(1).count() > 0
        return CODES["BLOCK"] if args.fail_on_pii and fails else 0
    if args.command == "evaluate":
        if not args.source:
            raise ValueError("name a folder of labelled cases")
        measured, short = evaluate.run(spark, args.source, recognizers=chosen)
        print(json.dumps({"measured": measured, "short": short, "paths": evaluate.path_coverage()}))
        return CODES["BLOCK"] if short else 0
    if args.command in ("scan-image", "redact-image"):
        if not args.source or not args.ocr or (args.command == "redact-image" and not args.out):
            raise ValueError("images need a folder, an OCR engine and, to be redacted, a folder to write to")
        df = images.read(spark, args.source).withColumn("words", images.read_words(F.col("image"), args.ocr))
        df = images.scan_images(df, recognizers=chosen, least_confidence=s.least_confidence).withColumn("origin", F.col("image.origin"))
        with written(df) as df:
            record(s, lambda: audit.summary(df, args.source))
            if args.command == "redact-image":
                images.save(df.select("origin", images.painted(F.col("image"), F.col("boxes")).alias("png")), args.out)
                emit(df.select("origin", F.size("boxes").alias("boxes")), None)
            else:
                emit(df.select("origin", "findings", "boxes"), args.out, args.format)
        return 0
    df = documents(spark, args)
    model = {}
    if args.engine:
        name = args.engine.__module__
        df = df.withColumn("_model", engines.ask_for_entities(F.col(args.text_col), args.engine, name))
        model = {"model_col": "_model", "engines": [name]}
    df = detect.scan(df, args.text_col, chosen, s.least_confidence, **model).drop("_model")
    if args.command == "redact-text":
        df = redact.redact(df, args.text_col, strategies=s.strategies, default=s.default_strategy, salt=s.salt)
    if args.command == "decide":
        df = policy.decide(df, s.policy)
    with written(df) as df:
        record(s, lambda: audit.summary(df, args.source or "text"))
        emit(df.drop(*([args.text_col] if args.command != "scan-text" else [])), args.out, args.format)
        actions = df.select("action").distinct().collect() if args.command == "decide" else []  # three at most
    return max((CODES[r.action] for r in actions), default=0)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        s = config.load(args.config)
        return run(SparkSession.builder.appName("lychgate").getOrCreate(), args, s)
    except (ValueError, FileNotFoundError) as e:
        print(f"lychgate: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
