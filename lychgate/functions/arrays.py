"""Array expressions whose cost stays linear: bound values, running folds, and slices of long texts.

Spark's own fold copies what it has gathered at each step, and a substring counts characters from the text's start. Here
a fold gathers in blocks, and a slice of a text is taken from chunks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
CHUNK = 512


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(array: Column, begin: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """An element of type kind for each of an array: emit(state before it, it), the states being those of a fold by step from begin. Up to a block is
    folded at once."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        return bound(F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda k: F.slice(a, k * BLOCK + 1, BLOCK))

    few = lambda a: F.aggregate(a, F.struct(begin.alias("s"), none.alias("out")), one, lambda r: r["out"])
    many = lambda a: F.flatten(F.aggregate(blocks(a), F.struct(begin.alias("s"), nones.alias("out")), block)["out"])
    folded = bound(array, lambda a: F.when(F.size(a) > BLOCK, many(a)).when(F.size(a) > 0, few(a)))
    return F.coalesce(folded, none)


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from start up to end of a text in chunks, at the cost of the chunks that hold them."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    held = F.when(first == last, F.get(pieces, first)).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    return F.when(end > start, held.substr(start - first * CHUNK + 1, end - start)).otherwise("")
