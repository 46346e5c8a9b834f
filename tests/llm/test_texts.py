"""Phrase fingerprints, spelling variants and token alignment against plain versions of what they are defined to be."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lychgate.llm import alignment, phrases, variants

A, RANKS, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def plain_phrases(text: str) -> set[str]:
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def fingerprint(text: str) -> str:
    return phrases.Phrases().read(text).fingerprint(text)


def test_phrases_are_those_of_the_plain_parse():
    for text in ("", "a", "aaaa", "abababab", "Größe 名前 𝄞𝄞𝄞 " * 9, "x" * 5000):
        read = phrases.Phrases().read(text)
        at, found = 0, []
        for n in read.sizes[1:]:
            found.append(text[at : at + n])
            at += n
        assert set(found) == plain_phrases(text) and len(found) == len(set(found))


def test_likeness_follows_the_jaccard_similarity_of_phrases():
    rng = random.Random(3)
    errors = []
    for k in range(60):
        letters = [chr(rng.randint(0x100, 0xD000)) for _ in range(9)]  # other phrases each time, for their hashes are always the same
        a = "".join(rng.choice(letters) for _ in range(2000))
        b = a[: len(a) * k // 60] + "".join(rng.choice(letters) for _ in range(len(a) - len(a) * k // 60))
        x, y = plain_phrases(a), plain_phrases(b)
        errors.append(phrases.likeness(fingerprint(a), fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(sum(errors) / 60) < 0.03 and max(map(abs, errors)) < 0.2
    assert phrases.likeness("", "") == 1 and phrases.likeness("", fingerprint("a")) == 0


def expected_fingerprints(rows: list) -> Counter:
    """Rows without an id come last, rows of one id by Spark's own hash of their texts, which the caller gives as h."""
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    out = Counter()
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = r.text or "", after.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        fp, other = fingerprint(t), fingerprint(edited)
        out[(r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp, other, phrases.likeness(fp, other), phrases.likeness(fp, fingerprint(u)))] += 1
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_of_all_documents(spark, docs, parts):
    rows = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    found = phrases.fingerprints(docs.repartition(parts))
    assert Counter(map(tuple, found.collect())) == expected_fingerprints(rows)
    assert phrases.fingerprints(docs.limit(0)).count() == 0


def test_one_document_is_its_own_next(spark):
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    (r,) = phrases.fingerprints(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1


def test_equal_rows_are_dealt_over_ranges(spark):
    """A third of all rows equal: none of the sort's tasks gets them all."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text = F.coalesce("text", F.lit(""))
        order = [F.col("doc_id").desc_nulls_last(), F.xxhash64(text), F.monotonically_increasing_id()]
        sizes = rows.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000
        assert phrases.fingerprints(rows).count() == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows: list, edit_every: int | None, least_chars: int, least_times: int) -> set[tuple]:
    counts: Counter = Counter()
    lower = str.maketrans(variants.UPPER, variants.LOWER)
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run if not edit_every or h % edit_every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_times}
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize(("every", "chars", "times"), [(97, 5, 3), (3, 5, 1), (None, 4, 1)])
def test_variants_equal_brute_force(spark, made, docs, every, chars, times):
    rng = random.Random(every or 1)
    texts = []
    for k in range(60):
        words = [rng.choice(["größe", "Größen", "straße", "letter", "letters", "better", "butter", "battery", "ÀÉÎÕÜ", "àéîõü", "aaaaa", "aaaaaa", "xaaaa"]) for _ in range(rng.randint(0, 30))]
        words += ["".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(10)]
        texts.append((k, " ".join(words)))
    more = spark.createDataFrame([*texts, (5, None), (None, "letter letter"), (None, "")], "doc_id long, text string")
    for table in (more, docs):
        found = variants.variants(table, edit_every=every, least_chars=chars, least_times=times).collect()
        want = expected_variants(table.collect(), every, chars, times)
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert variants.variants(docs.limit(0)).count() == 0


def test_no_key_of_the_join_is_hot(spark):
    """Words with one long beginning in common meet by more than that beginning."""
    words = ["international" + "".join(p) for p in __import__("itertools").product("abcdefghij", repeat=3)]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    length = F.length("word")
    keyed = table.select(F.explode(F.array(*variants.keys(F.col("word"), length, 0))).alias("key")).groupBy("key").count()
    assert keyed.agg(F.max("count")).first()[0] <= len(words)
    pairs = variants.near_pairs(table).collect()
    assert {(r.a, r.b) for r in pairs} == {(a, b) for a in words for b in words if a < b and near(a, b)} and len(pairs) == len({(r.a, r.b) for r in pairs})


def test_no_side_of_a_join_is_broadcast(spark, tmp_path):
    """Files of words are small enough for a broadcast, their entries are not."""
    words = spark.range(1000).select(F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), (F.col("id") + 1).alias("n"))
    words.write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    pairs = variants.near_pairs(words)
    found = variants.materialise(variants.forms(words, pairs), "found")
    for df in (pairs, variants.forms(words, pairs), variants.with_roots(found)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def expected_alignment(rows: list) -> Counter:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    docs, held, top = [], Counter(), defaultdict(int)
    for r in rows:
        a, b, xs, ys = [], [], [], []
        if r.text:
            a = t.encode(" " + r.text, add_special_tokens=False).ids
            b = s.encode(r.text)
            xs = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
            ys = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(xs) == b"".join(ys) == (" " + r.text).encode():
                a, b, xs, ys = [], [], [], []
        spans = []
        for parts in (xs, ys):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = []
        if len(a) * len(b) < 400_000:
            links = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        else:  # the plain way, but only near the diagonal
            j = 0
            for i, x in enumerate(spans[0]):
                while spans[1][j][1] <= x[0]:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][0] < x[1]:
                    links.append((i, k))
                    k += 1
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, ga, gb = [], [], []
        ends = sorted([(e, 0, k) for k, (_, e) in enumerate(spans[0])] + [(e, 1, k) for k, (_, e) in enumerate(spans[1])])
        for n, (e, side, k) in enumerate(ends):
            (gb if side else ga).append(str((b if side else a)[k]))
            if e in cuts and (n + 1 == len(ends) or ends[n + 1][0] > e):
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
                ga, gb = [], []
        pairs = [(a[i], b[j]) for i, j in links]
        held.update(set(pairs))
        docs.append((r.doc_id, len(a), len(b), groups, pairs))
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return Counter(
        (doc_id, n_a, n_b, len(groups), len(pairs), sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, n_a, n_b, groups, pairs in docs
    )


def test_alignment_equals_brute_force(spark, docs, monkeypatch):
    strange = ["▁", "a▁b", "<|endoftext|> in text", "<s> </s> <unk>", "two  spaces\n\n\tand 名前 𝄞 é é", " leading", "\x00nul", "antidisestablishmentarianism 1234567890"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate([*strange, "", None])], "doc_id long, text string")).repartition(3)
    want = expected_alignment(more.collect())
    assert Counter(map(tuple, alignment.alignments(more, A, RANKS, B).collect())) == want
    assert Counter(map(tuple, alignment.alignments(more, A, None, B).collect())) == want
    monkeypatch.setattr(alignment, "SLICE", 2000)  # a document of its own to many a slice
    assert Counter(map(tuple, alignment.alignments(more, A, RANKS, B).collect())) == want
    assert alignment.alignments(more.limit(0), A, RANKS, B).count() == 0
