"""Near-duplicates by b-bit MinHash.

Bands of full minima propose candidates; two low bits of each minimum, packed into longs, estimate their similarity by bit
counts, corrected for chance collisions; exact Jaccard on full shingle sets confirms every link.

Texts with the same shingle set form a class, and only classes are compared, so thousands of copies cost one row. A bucket is
read as a star around its least class, its hub, and what hangs together by stars is a family: two classes with a bucket in
common are always in one. Each class is first held against the least hub that its signature finds near, one text a class,
which joins most of a family at once; classes outside their family's largest component then against the nearest few, by
signature, of some of its members. Families that are still in several components meet by their rarest shingles: two
sets with num / den of their union in common share one of the rarest few of each (prefix filtering), where rarest
come the shingles of one component alone, which can join nothing. So a family of pages alike but unlinked costs its texts, not
its pairs, nothing is dropped by an estimate, and what a family is made of is never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, connected_components, identified, likely, materialise, mix, text_slices

HASHES = 128
ROWS, BANDS = 5, 25
BITS = 2
#: Pairs are confirmed exactly unless their estimate is lower than the threshold by this, which is six deviations: it leaves out
#: one linked pair in a hundred million, where bands leave out one in a million or more.
MARGIN = 0.25
BLOCK = 64
#: Members of a family's largest component that each class outside it looks at, and how many of them it is held against, in each of ROUNDS.
LOOKS, HELD, ROUNDS = 32, 3, 1
#: Classes of a family, and shingles of theirs, in one part; two parts meet in a task.
PART, PART_SHINGLES = 1_024, 2_000_000

_rng = np.random.default_rng(20240229)
_MULT = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_FACTORS = (_rng.integers(0, 2**62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str | None, n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence is one; no words, no shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    m = min(n, len(h))
    out = np.zeros(len(h) - m + 1, np.uint64)
    for i in range(m):
        out += mix(h[i : len(h) - m + 1 + i]) * _FACTORS[i]
    return np.unique(mix(out + np.uint64(m)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits, in slices so that very long texts stay in cache."""
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[None, i : i + 2048] * _MULT[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix(key ^ rows[:, i]) * _FACTORS[i]
    return mix(key).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The BITS low bits of each minimum, packed into longs."""
    per = 64 // BITS
    x = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, per)
    return np.bitwise_or.reduce(x << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def set_class(shingles: np.ndarray) -> int:
    """One 64-bit name for a shingle set."""
    with np.errstate(over="ignore"):
        x = mix(shingles * _FACTORS[40] + _FACTORS[41]).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed signatures, by bit counts: share of equal low bits, less what chance makes equal."""
    same = F.lit(0)
    for i in range(HASHES * BITS // 64):
        eq = F.bitwise_not(x[i].bitwiseXOR(y[i]))
        same = same + F.bit_count(eq.bitwiseAND(F.shiftright(eq, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return (same / F.lit(float(HASHES)) - chance) / (1 - chance)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, key): key names a row by its id and text, so that a row without an id has a name too."""
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(own.alias("id"), text.alias("t"), F.xxhash64(own, text).alias("key"))


def signatures(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, key (a name of the row by its id and text), n_shingles, class (null without shingles), bands, sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for pdf in text_slices(batches, "t"):
            size, name, bands, sigs = [], [], [], []
            for text in pdf["t"]:
                s = shingle_set(text, n, hashes)
                size.append(len(s))
                low = minima(s) if len(s) else None
                name.append(set_class(s) if len(s) else None)
                bands.append(None if low is None else band_keys(low))
                sigs.append(None if low is None else packed(low))
            ids = pd.array([None if x is None else int(x) for x in pdf["id"]], "Int64")
            yield pd.DataFrame({"id": ids, "key": pdf["key"].to_numpy(), "n_shingles": size, "class": pd.array(name, "Int64"), "bands": bands, "sig": sigs})

    # an id may be null, and pandas would make floats of such a column: it travels as text
    read = named(docs, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    return read.mapInPandas(run, "id long, key long, n_shingles long, class long, bands array<long>, sig array<long>")


def candidate_families(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(class, family) of all classes that buckets put together; and (x, y), each class with the least hub of its buckets to which
    its estimate is at least `least`."""
    buckets = classes.select("class", F.explode("bands").alias("bucket"))
    stars = buckets.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last").select("bucket", "hub")
    stars = materialise(stars, "stars")  # so that both sides of the join are plain shuffles, of which Spark splits a hot bucket
    spokes = materialise(buckets.join(stars, "bucket").where(F.col("class") != F.col("hub")).select("class", "hub").distinct(), "spokes")
    sig = classes.select("class", "sig")
    hubs = sig.select(F.col("class").alias("hub"), F.col("sig").alias("hub_sig"))
    seen = spokes.join(sig, "class").join(hubs, "hub").where(estimate(F.col("sig"), F.col("hub_sig")) >= least)
    found = connected_components(spokes, "class", "hub").select(F.col("node").alias("class"), F.col("component").alias("family"))
    return found, seen.groupBy(F.col("class").alias("x")).agg(F.min("hub").alias("y"))


def class_texts(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, t): one text of each class of reps (class, key). Repeated rows bring a text again, so it is picked before it is shuffled;
    texts of no such class are left where they are, but for few."""
    some = likely(named(docs, id_col, text_col).select("key", "t"), reps.select("key"), "key")
    return some.groupBy("key").agg(F.first("t").alias("t")).join(reps.select("class", "key"), "key").select("class", "t")


def confirmed(texts: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of classes whose sets have num / den of their union in common. texts: class, t.

    Every x meets its y in groups of about BLOCK: the text of y is read once a group, that of x once a pair.
    """
    many = materialise(pairs.groupBy("y").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups")), "groups")
    p = materialise(pairs.join(many, "y").select("x", "y", F.pmod(F.xxhash64("x"), "groups").cast("int").alias("g")), "pairs")
    wanted = p.select("y", "g", F.col("x").alias("class")).unionByName(p.select("y", "g").distinct().withColumn("class", F.col("y")))
    rows = texts.join(wanted, "class").select("y", "g", "class", "t")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHash()
        sets = {c: shingle_set(t, n, hashes) for c, t in zip(pdf["class"].tolist(), pdf["t"], strict=True)}
        hub = sets.pop(int(key[0]))
        good = []
        for c, s in sets.items():
            if min(len(s), len(hub)) * den >= max(len(s), len(hub)) * num:
                both = len(np.intersect1d(s, hub, assume_unique=True))
                if den * both >= num * (len(s) + len(hub) - both):
                    good.append(c)
        return pd.DataFrame({"x": good, "y": int(key[0])}, dtype="int64")

    return rows.groupBy("y", "g").applyInPandas(run, "x long, y long")


def outsiders(members: DataFrame, sig: DataFrame, least: float, salt: int) -> DataFrame:
    """(x, y): classes outside the largest component of their family (members: class, family, component) with the HELD of LOOKS of
    its members, taken by a hash, whose signatures are the nearest to theirs, if their estimate is at least `least`."""
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    home = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    told = materialise(members.join(home, "family").join(sig, "class"), "open-members")
    first = Window.partitionBy("family").orderBy(F.xxhash64("class", F.lit(salt)))
    seen = told.where("component = home").withColumn("n", F.row_number().over(first)).where(F.col("n") <= LOOKS)
    seen = seen.groupBy("family").agg(F.collect_list(F.struct("class", "sig")).alias("seen"))
    looks = F.transform("seen", lambda s: F.struct(estimate(F.col("sig"), s["sig"]).alias("est"), s["class"].alias("y")))
    near = F.slice(F.sort_array(F.filter(looks, lambda e: e["est"] >= least), asc=False), 1, HELD)
    return told.where("component <> home").join(seen, "family").select(F.col("class").alias("x"), F.explode(near).alias("e")).select("x", "e.y")


def shingled(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(class, family, component, n, shingles) of members (class, family, component)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for pdf in text_slices(batches, "t"):
            sets = [shingle_set(t, n, hashes).view(np.int64) for t in pdf["t"]]
            yield pdf.drop(columns="t").assign(n=[len(x) for x in sets], shingles=sets)

    read = texts.join(members, "class").select("class", "family", "component", "t")
    return read.mapInPandas(run, "class long, family long, component long, n long, shingles array<long>")


def live_members(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(class) of those that may have a link to another component of their family.

    Shingles of a family are put in one order: those of one component alone first, then by how many members have them, then by
    value. Two sets with num / den of their union in common share one of the first n - num n / den + 1 of each, so a class
    whose first ones no other component's have can be left out.
    """
    rows = sets.select("class", "family", "component", F.explode("shingles").alias("shingle"))
    held = rows.groupBy("family", "shingle").agg(F.count("*").alias("df"), F.min("component").alias("a"), F.max("component").alias("b"))
    across = materialise(held.where("a < b").select("family", "shingle", "df"), "across")
    shared = rows.drop("component").join(across, ["family", "shingle"]).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    ranked = sets.select("class", "family", "component", "n").join(shared, "class")
    most = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("shared"))  # of the shared ones
    keys = ranked.where(most > 0).select("class", "family", "component", F.explode(F.slice("shared", F.lit(1), most.cast("int"))).alias("s"))
    keys = materialise(keys.select("class", "family", "component", F.col("s.shingle").alias("shingle")), "prefixes")
    met = keys.groupBy("family", "shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("family", "shingle")
    return keys.join(met, ["family", "shingle"]).select("class").distinct()


def links_of(sets: list[np.ndarray], sigs: np.ndarray, components: np.ndarray, sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sets that reach num / den, as many as it takes to join the components that they join; the likeliest, by signature, are
    tried first, and none within a component. sides: only pairs across are asked for, if there are two."""
    s, size = sigs.view(np.uint64), np.array([len(x) for x in sets])
    across = len(set(sides.tolist())) > 1
    x, y, est = [], [], []
    for k in range(len(sets)):
        eq = ~(s[k] ^ s[k + 1 :])
        same = np.bitwise_count(eq & (eq >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
        like = (same / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)
        n = size[k + 1 :]
        good = (like >= num / den - MARGIN) & (components[k + 1 :] != components[k]) & (np.minimum(n, size[k]) * den >= np.maximum(n, size[k]) * num)
        good &= (sides[k + 1 :] != sides[k]) | (not across)
        at = np.flatnonzero(good)
        x.append(np.full(len(at), k))
        y.append(at + k + 1)
        est.append(like[at])
    joined = {c: c for c in components.tolist()}

    def root(c: int) -> int:
        while joined[c] != c:
            joined[c] = c = joined[joined[c]]
        return c

    out, names = [], components.tolist()
    a, b = np.concatenate(x), np.concatenate(y)
    for k in np.argsort(-np.concatenate(est), kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        ci, cj = root(names[i]), root(names[j])
        if ci != cj:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                joined[ci] = cj
                out.append((i, j))
    return out


def remaining_links(sets: DataFrame, sig: DataFrame, num: int, den: int) -> DataFrame:
    """Links (x, y) between components of a family, enough to join what they join.

    Live members of a family are dealt into parts of about PART classes and PART_SHINGLES shingles, and every two parts meet in one
    group, with their sets: a family of n classes costs a class n / PART copies of its set.
    """
    live = materialise(sets.join(live_members(sets, num, den), "class").join(sig, "class"), "live")
    parts = live.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    dealt = live.join(materialise(parts, "parts"), "family").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "component", "sig", "shingles")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["class"].tolist()
        found = links_of([np.asarray(x).view(np.uint64) for x in pdf["shingles"]], np.stack(pdf["sig"].to_numpy()), pdf["component"].to_numpy(), pdf["part"].to_numpy(), num, den)
        return pd.DataFrame({"x": [names[a] for a, _ in found], "y": [names[b] for _, b in found]}, dtype="int64")

    return dealt.groupBy("family", "i", "j").applyInPandas(run, "x long, y long")


def components_of(links: DataFrame) -> DataFrame:
    return connected_components(links, "x", "y").select(F.col("node").alias("class"), "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id, component_id, kept.

    Links join texts whose shingle sets have at least num / den of their union in common; component_id is the smallest id
    that links reach. Null and empty texts have no shingles and are linked with nothing, copies of them included. Rows without
    an id link others as all rows do, but never name a component unless no row of it has an id (then component_id is null and
    kept is true). Repeated rows keep their number. Columns of docs other than the two named are not read; an empty table
    gives an empty result.
    """
    rows = materialise(signatures(docs, shingle, id_col, text_col), "signatures")
    worded = rows.where("class IS NOT NULL")
    classes = worded.select("class", "bands", "sig").dropDuplicates(["class"])
    reps = worded.groupBy("class").agg(F.min("key").alias("key"), F.min("id").alias("rep"))
    families, first = candidate_families(classes, num / den - MARGIN)
    families = materialise(families.join(reps.select("class", "key"), "class"), "families")
    texts = materialise(class_texts(docs, families, id_col, text_col), "class-texts")
    links = materialise(confirmed(texts, first, shingle, num, den), "links-first")
    sig = classes.select("class", "sig")
    for turn in range(ROUNDS + 1):
        found = materialise(components_of(links), f"components-{turn}")
        members = materialise(families.join(found, "class", "left").select("class", "family", F.coalesce("component", "class").alias("component")), f"members-{turn}")
        if turn < ROUNDS:
            pairs = materialise(outsiders(members, sig, num / den - MARGIN, turn), f"pairs-{turn}")
            links = links.unionByName(materialise(confirmed(texts, pairs, shingle, num, den), f"links-{turn}"))
    open_ = members.groupBy("family").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("family")
    sets = materialise(shingled(texts, members.join(open_, "family"), shingle), "sets")
    more = materialise(remaining_links(sets, sig, num, den), "links-more")
    groups = components_of(links.unionByName(more)).withColumnRenamed("component", "group")
    known = reps.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
    least = known.groupBy("group").agg(F.min("rep").alias("component_id"))
    names = known.join(least, "group").select("class", "component_id")
    out = worded.select("id", "n_shingles", "class").join(names, "class", "left")
    # rows without words have no class to be joined by, and would all meet in one task
    out = out.unionByName(rows.where("class IS NULL").select("id", "n_shingles", "class", F.col("id").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("class").alias("class_id"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def representatives(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each group of near-duplicates, with all its columns: the one with the smallest doc_id.

    Texts without a doc_id, and different texts that share one, are documents of their own, which come after all others. Rows
    without words all stay; of rows that repeat id and text one stays.
    """
    named = identified(docs)
    found = near_duplicates(named, shingle, num, den, "uid", "row.text").where("kept")
    kept = materialise(found.groupBy(F.col("doc_id").alias("uid")).agg(F.count("*").alias("rows"), F.first(F.col("class_id").isNull()).alias("bare")), "kept")
    both = named.join(kept, "uid")
    return both.where("rows = 1 OR bare").unionByName(both.where("rows > 1 AND NOT bare").dropDuplicates(["uid"])).select("row.*")
