"""Column profiles of a long table (table, column, pos, value): one pass over all values, or, where only the first ones count, two."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.recognizers import RECOGNIZERS, Recognizer

SAMPLE = 500
TYPE_SAMPLE = 200
LEAST_RATIO = 0.3
# Words that count as boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f", "0", "1")


def as_text(name: str, kind: T.DataType) -> Column:
    """A value as text. Doubles are written out in full where Spark would use an exponent below 10^16."""
    c = F.col(name)
    if isinstance(kind, T.FloatType | T.DoubleType):
        whole = F.concat(F.format_string("%.0f", c.cast("double")), F.lit(".0"))
        return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16) & (c == F.floor(c)), whole).when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), c.cast("decimal(38,10)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def texts(df: DataFrame) -> list[Column]:
    """All columns as text, nested ones as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else as_text(f"`{f.name}`", f.dataType)).alias(f.name) for f in df.schema]


def long_form(df: DataFrame, table: str, order: list[Column] | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """(table, column, pos, value) of the first `sample` rows (of all, if None); nested columns become JSON.

    Rows are taken in the given order, or as the source has them. One row each is read, whatever the number of columns.
    """
    if sample is not None:
        df = (df.orderBy(*order) if order else df).limit(sample)
    wide = df.select(F.monotonically_increasing_id().alias("__pos"), *texts(df))
    long = wide.unpivot("__pos", df.columns, "column", "value")
    return long.select(F.lit(table).alias("table"), "column", F.col("__pos").alias("pos"), "value")


def normalised(value: Column) -> Column:
    """Stripped of Unicode space; null if nothing is left."""
    visible = lambda c: F.ascii(c).between(0x21, 0x7E)
    # values that begin and end with visible ASCII characters have nothing to strip
    bare = visible(value) & visible(F.right(value, F.lit(1)))
    stripped = F.when(bare, value).otherwise(F.regexp_replace(value, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    return F.when(stripped != "", stripped)


def matches(value: Column, r: Recognizer) -> Column:
    whole = value.rlike(r"(?U)\A(?:" + r.pattern + r")\z")
    return whole & r.validator(value) if r.validator else whole


#: Recognizers whose hits share a long, beside three bits of types.
BITS = 56
LOW = 0xFFFFFFFF
#: Values of up to so many characters are shuffled as they are and tested once each; longer ones are tested where they are read and shuffled
#: as digests, so no long text is.
SHORT = 64


def measured(df: DataFrame) -> DataFrame:
    """With the numbers of characters, letters and digits of v."""
    v = F.col("v")
    return df.withColumns({"chars": F.length(v).cast("long"), "letters": letters_of(v).cast("long"), "digits": digits_of(v).cast("long")})


def facts_of(chosen: list[Recognizer]) -> list[Column]:
    """What the sums need of a measured v, as a few numbers; a test is made only where the numbers of characters allow it."""
    v, chars, letters, digits = (F.col(c) for c in ("v", "chars", "letters", "digits"))
    others = chars - letters - digits
    is_boolean, is_date, is_number = types_of(v)
    types = [(chars <= max(map(len, BOOLEAN_WORDS))) & is_boolean, (letters == 0) & (others == 2) & is_date, (letters == 0) & (digits > 0) & is_number]
    bits = lambda tests: sum((F.when(test, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, test in enumerate(tests)), F.lit(0).cast("long"))
    held = [chosen[k : k + BITS] for k in range(0, len(chosen), BITS)]
    masks = [bits([r.fits(letters, digits, others) & matches(v, r) for r in part]).alias(f"mask{n}") for n, part in enumerate(held)]
    return [chars, (F.shiftleft(letters, 32) + digits).alias("signs"), bits(types).alias("types"), *masks]


def tested(long: DataFrame, chosen: list[Recognizer]) -> DataFrame:
    """Sums over all values of each column: equal values are counted first, before and after the shuffle, then tested once."""
    v = F.col("v")
    facts, names = facts_of(chosen), ["chars", "signs", "types", *[f"mask{n}" for n in range(-(-len(chosen) // BITS))]]
    read = long.select("table", "column", normalised(F.col("value")).alias("v"))
    read = measured(read.select("table", "column", F.when(F.length(v) <= SHORT, v).alias("short"), F.when(F.length(v) > SHORT, v).alias("v")))
    digest = F.when(v.isNotNull(), F.struct(F.xxhash64("v").alias("one"), F.hash("v").alias("two"), *facts)).alias("digest")
    kinds = read.select("table", "column", "short", digest).groupBy("table", "column", "short", "digest").agg(F.count("*").alias("n"))
    kinds = measured(kinds.withColumnRenamed("short", "v")).withColumn("some", v.isNotNull() | F.col("digest").isNotNull())
    known = [F.when(v.isNotNull(), fact).otherwise(F.col(f"digest.{name}")).alias(name) for name, fact in zip(names, facts, strict=True)]
    kinds, some = kinds.select("table", "column", "n", "some", *known), F.col("some")
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(LOW))), (lambda c: F.shiftright(F.col(c), 32))
    has = lambda c, k: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
    total = lambda c: F.coalesce(F.sum(F.when(some, F.col("n") * c)), F.lit(0))
    every = lambda k: F.coalesce(F.every(F.when(some, has("types", k))), F.lit(False))
    counted = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return kinds.groupBy("table", "column").agg(
        F.sum("n").alias("total_count"), counted(~some).alias("null_count"), F.count_if(some).alias("distinct_count"), total(F.col("chars")).alias("chars"), counted(some).alias("sample_size"),
        total(F.col("chars")).alias("sample_chars"), total(high("signs")).alias("letters"), total(low("signs")).alias("digits"), every(0).alias("b"), every(1).alias("d"), every(2).alias("m"),
        *[counted(has(f"mask{k // BITS}", k % BITS)).alias(f"hit_{k}") for k in range(len(chosen))],
    )


def letters_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def digits_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Nd}\x{b2}\x{b3}\x{b9}]+", ""))


def types_of(value: Column) -> tuple[Column, Column, Column]:
    """Whether a value is a boolean word, a date, a number."""
    is_date = value.rlike(r"(?U)\A(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\z")
    return F.lower(value).isin(*BOOLEAN_WORDS), is_date, F.translate(value, ",", "").rlike(r"(?U)\A[+-]?\d+(?:\.\d+)?\z")


def profile(long: DataFrame, recognizers: Iterable[Recognizer] = RECOGNIZERS, pattern_sample: int | None = SAMPLE, type_sample: int | None = TYPE_SAMPLE) -> DataFrame:
    """A row for each (table, column).

    total_count, null_count, distinct_count, sample_size, avg_length (rounded to 2 places), digit_ratio, alpha_ratio
    (to 4), inferred_type, pattern_hits [(entity, ratio)] and what follows from these: non_null_count, cardinality_ratio,
    null_ratio, best_entity, best_ratio. Blank values are null. Patterns and ratios look at the first pattern_sample
    values that aren't null, types at the first type_sample; at all of them, if None.
    """
    chosen = list(recognizers)
    v = long.withColumn("v", normalised(F.col("value")))
    known = F.col("v").isNotNull()
    # values are told apart by 96 bits of two hashes, so that no text of a column is shuffled
    counts = [
        F.count("*").alias("total_count"),
        F.count_if(~known).alias("null_count"),
        F.count_distinct(F.when(known, F.xxhash64("v")), F.when(known, F.hash("v"))).alias("distinct_count"),
        F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("chars"),
    ]
    limits = [n for n in (pattern_sample, type_sample) if n is not None]
    some = v.where(known).select("table", "column", "pos", "v") if limits else v
    if limits:
        # the first values of each column: where both are limited, before the shuffle, so a column is never in one task
        first = Window.partitionBy("table", "column").orderBy("pos")
        some = some.withColumn("n", F.row_number().over(first))
        some = some.where(F.col("n") <= max(limits)) if len(limits) == 2 else some
    used, typed = (known if n is None else known & (F.col("n") <= n) for n in (pattern_sample, type_sample))
    text = F.when(used, F.col("v"))
    is_boolean, is_date, is_number = types_of(F.col("v"))
    every = lambda test: F.coalesce(F.every(F.when(typed, test)), F.lit(False))
    hits = [F.sum(F.when(used, matches(F.col("v"), r).cast("int"))).alias(f"hit_{k}") for k, r in enumerate(chosen)]
    firsts = [
        F.count_if(used).alias("sample_size"),
        F.sum(F.length(text)).alias("sample_chars"),
        F.sum(letters_of(text)).alias("letters"),
        F.sum(digits_of(text)).alias("digits"),
        every(is_boolean).alias("b"),
        every(is_date).alias("d"),
        every(is_number).alias("m"),
        *hits,
    ]
    if limits:
        sums = v.groupBy("table", "column").agg(*counts).join(some.groupBy("table", "column").agg(*firsts), ["table", "column"], "left")
    else:
        sums = tested(long, chosen)
    sums = sums.na.fill(0).na.fill(False)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    entities = list(dict.fromkeys(r.entity for r in chosen))
    ratios = [F.greatest(*[c for k, r in enumerate(chosen) if r.entity == e for c in [share(f"hit_{k}", "sample_size")]], F.lit(0.0)) for e in entities]
    pairs = F.array(*[F.struct((-q).alias("a"), F.lit(k).alias("k"), F.lit(e).alias("entity"), q.alias("ratio")) for k, (e, q) in enumerate(zip(entities, ratios, strict=True))])
    ranked = F.array_sort(F.filter(pairs, lambda p: p["ratio"] >= LEAST_RATIO)) if entities else F.array().cast("array<struct<a: double, k: int, entity: string, ratio: double>>")
    kind = F.when(F.col("sample_size") == 0, "empty").when(F.col("b"), "boolean").when(F.col("d"), "date").when(F.col("m"), "numeric").otherwise("text")
    out = sums.withColumn("non_null_count", F.col("total_count") - F.col("null_count")).select(
        "table", "column", "total_count", "null_count", "non_null_count", "distinct_count", "sample_size",
        F.round(share("chars", "non_null_count"), 2).alias("avg_length"),
        F.round(share("digits", "sample_chars"), 4).alias("digit_ratio"),
        F.round(share("letters", "sample_chars"), 4).alias("alpha_ratio"),
        kind.alias("inferred_type"),
        F.transform(ranked, lambda p: F.struct(p["entity"].alias("entity"), F.round(p["ratio"], 4).alias("ratio"))).alias("pattern_hits"),
    )
    return (
        out.withColumn("cardinality_ratio", share("distinct_count", "non_null_count"))
        .withColumn("null_ratio", share("null_count", "total_count"))
        .withColumn("best_entity", F.get("pattern_hits", F.lit(0))["entity"])
        .withColumn("best_ratio", F.get("pattern_hits", F.lit(0))["ratio"])
    )
