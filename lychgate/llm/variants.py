"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut into two segments of l // 2 and l - l // 2 code points. One edit leaves one segment whole: the first, in
place, or the last, moved by the difference in length. So a word is indexed under its segments and probes, as the equal or
one longer word of a pair, with its own substrings at those places. The edit lies in the other segment, of which, cut in two
the same way, one half is whole too; it is part of the key, so that a common beginning or ending is no hot key. Candidates
are verified, and then deduplicated, for a pair may share several keys.

No join broadcasts a side: files of words are small beside the rows that they hold. Only built-in functions: counts are summed before they are shuffled, keys are 64-bit hashes, and an edit is told by a
banded distance in the join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEAST_CHARS, LEAST_TIMES = 5, 3
#: One in so many (document, word) pairs is misspelt on purpose, by a checksum.
EDIT_EVERY = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: Chains of forms double their counts at each step, so they end after 63; each round doubles the steps taken.
MOST_ROUNDS = 8


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_every: int | None = EDIT_EVERY) -> DataFrame:
    """(word, n): maximal letter runs with A-Z lowered and their number; with edit_every, after the deletions that checksums ask for."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if edit_every:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        words = words.select(F.when(F.col("h") % edit_every == 0, cut).otherwise(F.col("run")).alias("word"))
    else:
        words = words.select(F.col("run").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def keys(word: Column, length: Column, longer: int) -> list[Column]:
    """Four keys under which a word of `length` and one of `length + longer` meet; word is the one of length + longer.

    An index entry is the case longer = 0, where both are the same word.
    """
    a = F.floor(length / 2).cast("int")
    made = []
    # segment, its place in word; the rest, where the edit is, its place in word and its length in the indexed word
    for name, at, size, rest_at, rest in (("head", F.lit(1), a, a + 1, length - a), ("tail", a + 1 + longer, length - a, F.lit(1), a)):
        half = F.floor(rest / 2).cast("int")
        for part, sub_at, sub in (("head", rest_at, half), ("tail", rest_at + half + longer, rest - half)):
            made.append(F.xxhash64(length, F.lit(f"{name} {part}"), word.substr(at, size), word.substr(sub_at, sub)))
    return made


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of different words of `words` (word, n) one edit apart, once; a is the shorter, or of two equally long the smaller one."""
    word, length = F.col("word"), F.length("word")
    index = words.select(F.explode(F.array(*keys(word, length, 0))).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    probes = F.array(*keys(word, length, 0), *keys(word, length - 1, 1))
    probe = words.select(F.explode(probes).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # entries are many times the words, which Spark's estimate doesn't see: it would broadcast them
    met = index.join(probe.hint("merge"), "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")) & (F.length("a") == F.length("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, form, n, n_near, form_n): of a word's near words the most frequent (ties: the smallest in code-point order) if at least twice as frequent."""
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    each = pairs.select(F.inline(sides))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    out = words.join(best.hint("merge"), "word", "left")
    most = -F.col("best.less")
    kept = most >= 2 * F.col("n")
    return out.select("word", F.when(kept, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, most).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Adds root: where following forms from a word ends. Every round takes twice the steps of the one before."""
    roots = materialise(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge")
        if roots.join(step, "root", "left_semi").isEmpty():
            break
        roots = materialise(roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    else:
        raise RuntimeError(f"roots did not settle in {MOST_ROUNDS} rounds")
    return found.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_every: int | None = EDIT_EVERY, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words have at least least_chars (5 or more, so that every half holds a letter) code points and least_times occurrences. Null
    and empty texts have no words; a row without an id counts with an empty id; repeated rows count as often as they are there. An
    empty table gives an empty result. Other columns are not read.
    """
    if least_chars < 4:
        raise ValueError("words of under four code points have no halves to meet by")
    words = occurrences(docs, id_col, text_col, edit_every).where((F.length("word") >= least_chars) & (F.col("n") >= least_times))
    words = materialise(words, "words")
    found = materialise(forms(words, near_pairs(words)), "forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
