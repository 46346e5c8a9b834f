"""Whether two runs over the same input say the same: multiset difference both ways, and what they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tallied(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every row of either run once, with how often each has it (_first, _second): each run is made once, and one shuffle brings both together."""
    both = first.withColumns({"_first": F.lit(1), "_second": F.lit(0)}).unionByName(second.select(*first.columns).withColumns({"_first": F.lit(0), "_second": F.lit(1)}))
    return both.groupBy(*[F.col(f"`{c}`") for c in first.columns]).agg(F.sum("_first").alias("_first"), F.sum("_second").alias("_second"))


def more(a: str, b: str) -> Column:
    return F.greatest(F.col(a) - F.col(b), F.lit(0))


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of one run that the other lacks, as often as it lacks them, with side: first or second. Empty if the runs agree.

    Columns are matched by name; maps can't be compared, so a run with one gives its entries instead.
    """
    sides = F.concat(F.array_repeat(F.lit("first"), more("_first", "_second").cast("int")), F.array_repeat(F.lit("second"), more("_second", "_first").cast("int")))
    return tallied(first, second).select(*[F.col(f"`{c}`") for c in first.columns], F.explode(sides).alias("side"))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: in_both (rows that both runs have, as often as both have them), missing (only the first has), extra (only the second has)."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return tallied(first, second).agg(total(F.least("_first", "_second"), "in_both"), total(more("_first", "_second"), "missing"), total(more("_second", "_first"), "extra"))
