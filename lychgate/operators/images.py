"""From OCR words to boxes: words joined with one space, findings mapped to the words they overlap; and images painted over there."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import BLOCK, bound, running
from . import detect

WORDS = "array<struct<text: string, left: int, top: int, width: int, height: int, confidence: double>>"
PLACED = "struct<start: int, end: int, left: int, top: int, width: int, height: int>"
BOXES = "array<struct<left: int, top: int, width: int, height: int>>"
LEAST_WORD_CONFIDENCE = 30.0
#: Pixels painted around a box.
PADDING = 2
#: PNG colour types by number of channels, and the order in which Spark's image source stores them.
PNG_COLOUR = {1: 0, 3: 2, 4: 6}
CHANNELS = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder: a column image (origin, height, width, nChannels, mode, data), files that are no images among them."""
    return spark.read.format("image").load(path)


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The pixels of an image of Spark's image source, as RGB; raises where the file was none, so that it can't pass as a clean one."""
    if height <= 0 or width <= 0 or channels not in CHANNELS:
        raise ValueError("an image can't be read")
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, CHANNELS[channels]]


def png(p: np.ndarray) -> bytes:
    """Pixels as a PNG file that holds nothing else: no metadata, no profile."""
    height, width, channels = p.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), p.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, PNG_COLOUR[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_words(image: Column, make: Callable[[], Callable[[bytes], list[dict]]]) -> Column:
    """Words of an OCR engine for an image column. make() builds the engine once a worker; it gets a PNG file and returns dicts with
    the fields of WORDS. A failing engine or an unreadable image fails the job: an image that was not read is not a clean one."""

    @F.pandas_udf(WORDS)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        ask = make()
        for part in batches:
            yield pd.Series([ask(png(pixels(*x))) for x in zip(part["height"], part["width"], part["nChannels"], part["data"], strict=True)], dtype=object)

    return usable(run(image))


def painted(image: Column, boxes: Column, pad: int = PADDING) -> Column:
    """A PNG file of the image with opaque black over the boxes and pad pixels around them, both ends included."""

    @F.pandas_udf("binary")
    def run(images: pd.DataFrame, places: pd.Series) -> pd.Series:
        out = []
        for height, width, channels, data, found in zip(images["height"], images["width"], images["nChannels"], images["data"], places, strict=True):
            p = pixels(height, width, channels, data).copy()
            for b in found if found is not None else ():
                area = p[max(0, b["top"] - pad) : max(0, b["top"] + b["height"] + pad + 1), max(0, b["left"] - pad) : max(0, b["left"] + b["width"] + pad + 1)]
                area[:, :, : min(channels, 3)] = 0
                area[:, :, 3:] = 255
            out.append(png(p))
        return pd.Series(out, dtype=object)

    return run(image, boxes)


def save(df: DataFrame, folder: str, name_col: str = "origin", file_col: str = "png") -> None:
    """Writes each row's file into a folder that all executors share, named after its origin and a hash of it; a repeated task replaces
    its files whole."""

    def write(rows: Iterator) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for row in rows:
            origin = row[name_col]
            fd, part = tempfile.mkstemp(dir=folder)
            with os.fdopen(fd, "wb") as f:
                f.write(row[file_col])
            os.replace(part, Path(folder) / f"{Path(origin).stem}-{hashlib.sha256(origin.encode()).hexdigest()[:12]}.png")

    df.select(name_col, file_col).foreachPartition(write)


def usable(words: Column) -> Column:
    """Words that an OCR engine is sure enough of and that aren't blank."""
    return F.filter(words, lambda w: (w["confidence"] >= LEAST_WORD_CONFIDENCE) & (F.trim(w["text"]) != ""))


def placed(words: Column) -> Column:
    """Words with their [start, end) in the joined text."""

    def box(at: Column, w: Column) -> Column:
        end = at + F.length(w["text"])
        return F.struct(at.alias("start"), end.alias("end"), w["left"].alias("left"), w["top"].alias("top"), w["width"].alias("width"), w["height"].alias("height"))

    return running(words, F.lit(0), lambda at, w: at + F.length(w["text"]) + 1, box, PLACED)


def boxes(words: Column, findings: Column) -> Column:
    """Boxes of the words that findings overlap, each once, in order of findings. Words go by blocks, so that a finding looks at the words
    of its own blocks alone; texts without a finding place no word."""
    box = lambda w: F.struct(w["left"].alias("left"), w["top"].alias("top"), w["width"].alias("width"), w["height"].alias("height"))

    def block(all_: Column, k: Column) -> Column:
        return bound(F.slice(all_, k * BLOCK + 1, BLOCK), lambda ws: F.struct(F.element_at(ws, 1)["start"].alias("start"), F.element_at(ws, -1)["end"].alias("end"), ws.alias("words")))

    def hit(blocks: Column) -> Column:
        near = lambda f: F.flatten(F.transform(F.filter(blocks, lambda b: detect.overlaps(f, b)), lambda b: b["words"]))
        return F.array_distinct(F.flatten(F.transform(findings, lambda f: F.transform(F.filter(near(f), lambda w: detect.overlaps(f, w)), box))))

    # a finding holds text, so where there is one there are words
    made = bound(placed(words), lambda all_: bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: block(all_, k)), hit))
    return F.when(F.size(findings) > 0, made).otherwise(F.array().cast(BOXES))


def scan_images(df: DataFrame, words_col: str = "words", **how) -> DataFrame:
    """Adds full_text, findings and boxes (each once, in order of findings) to rows with OCR words."""
    joined = df.withColumn("full_text", F.array_join(F.transform(words_col, lambda w: w["text"]), " "))
    return detect.scan(joined, "full_text", **how).withColumn("boxes", boxes(F.col(words_col), F.col("findings")))
