"""Every operator against brute force, round trips or held-out labels, on tables with all kinds of rows."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lychgate.llm import common, licenses, media, minhash, mixing, packing, quality, sharding, suffixes, topk, warc
from lychgate.llm.common import connected_components, materialise
from lychgate.llm.queries import tokenizer_paths

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_sets(rows, n):
    out = []
    for r in rows:
        ws = WORD.findall(lower(r.text))
        out.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(docs, rows, n, num):
    sets = shingle_sets(rows, n)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            groups[root(k)].append(r.doc_id)
    want = Counter((r.doc_id, len(sets[k]), min(groups[root(k)], default=None), r.doc_id == min(groups[root(k)], default=None)) for k, r in enumerate(rows))
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, n, num, 100).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want


def test_large_family_is_split_and_whole(made, spark):
    """A family of several blocks: mutations of one text, in exact agreement with brute force."""
    base = made.prose(120).split()
    texts = []
    for _ in range(260):
        t = list(base)
        for _ in range(made.rng.randint(0, 9)):
            t[made.rng.randrange(120)] = made.rng.choice("xyzw") * made.rng.randint(1, 9)
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test_near_duplicates_match_brute_force(df, df.collect(), 3, 85)


def test_buckets_whose_hub_is_unlike_their_members(made, spark, monkeypatch):
    """Texts that quote one passage share buckets with many that they aren't linked with; every link is found all the same."""
    monkeypatch.setattr(minhash, "BLOCK", 9)
    passage = made.prose(90).split()
    texts = [" ".join(passage + made.prose(made.rng.randint(60, 110)).split()) for _ in range(150)]
    for _ in range(40):
        words = list(passage)
        for _ in range(made.rng.randint(0, 3)):
            words[made.rng.randrange(90)] = made.rng.choice("xyz") * made.rng.randint(1, 9)
        texts.append(" ".join(words + made.prose(made.rng.randint(0, 9)).split()))
    made.rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test_near_duplicates_match_brute_force(df, df.collect(), 3, 85)


def test_large_group_costs_a_text_a_pair(made, spark, monkeypatch):
    """A group of thousands of classes: its texts are read about once each, not in blocks of all with all."""
    base = made.prose(200).split()
    texts = []
    for k in range(3000):
        words = list(base)
        words[k % 200] = f"w{k}"
        words[(k * 7) % 200] = f"v{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = asked_of(monkeypatch)
    got = minhash.near_duplicates(df, 3, 85, 100).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert sum(asked) <= 1.05 * len(texts), asked


def asked_of(monkeypatch) -> list[int]:
    """Gets the number of pairs that are confirmed on full sets, in each round."""
    asked, plain = [], minhash.confirmed

    def count(texts, pairs, *how):
        asked.append(pairs.count())
        return plain(texts, pairs, *how)

    monkeypatch.setattr(minhash, "confirmed", count)
    return asked


def test_a_family_of_unlinked_pages_costs_its_texts(made, spark, monkeypatch):
    """Pages of one template, alike but not linked: pairs grow with the pages, not with their square."""
    template = made.prose(160)
    for n in (1000, 4000):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(template), *[F.concat(F.lit(" w"), (F.col("id") * 40 + k).cast("string")) for k in range(40)]).alias("text"))
        asked, live, plain = asked_of(monkeypatch), [], minhash.live_members
        monkeypatch.setattr(minhash, "live_members", lambda *a, live=live: live.append(out := plain(*a)) or out)
        got = minhash.near_duplicates(df, 3, 85, 100)
        assert got.where("kept").count() == n and sum(asked) <= 4 * n, asked
        assert live[0].count() == 0
        monkeypatch.undo()


def test_links_lead_through_rows_without_an_id(made, spark):
    words = [made.prose(100).split()]
    for k in (1, 2):
        words.append([*words[-1][:-5], *[f"{k}x{i}" for i in range(5)]] if k == 1 else [*[f"{k}y{i}" for i in range(5)], *words[-1][5:]])
    a, x, b = map(" ".join, words)
    rows = [(7, a), (None, x), (9, b), (None, "alone with its own words"), (None, x), (3, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(7, 7, True), (9, 7, False), (None, 7, False), (None, 7, False), (None, None, True), (3, 3, True)])
    assert {r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(7, a), (9, b)], "doc_id long, text string"), 3, 85, 100).collect()} == {7, 9}


def test_recall_on_mixed_families(made, spark, monkeypatch):
    """Families whose members lie on both sides of the threshold: components equal brute force, so every link was found."""
    rng, texts = made.rng, []
    for _ in range(50):
        base = made.prose(rng.randint(40, 160)).split()
        far = rng.choice((0.01, 0.03, 0.05, 0.08))
        texts += [" ".join(w if rng.random() > far else f"{rng.randint(0, 10**9)}q" for w in base) for _ in range(24)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for part in (1024, 5):
        monkeypatch.setattr(minhash, "PART", part)
        test_near_duplicates_match_brute_force(df, df.collect(), 3, 85)


def test_estimate_is_corrected(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (0.0, 0.5, 0.9):
        b = np.concatenate([a[: int(1000 * share)], rng.integers(0, 2**63, 1000 - int(1000 * share)).astype(np.uint64)])
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        sigs = [minhash.packed(minhash.minima(np.unique(x))).tolist() for x in (a, b)]
        df = spark.createDataFrame([tuple(sigs)], "x array<long>, y array<long>")
        assert abs(df.select(minhash.estimate(F.col("x"), F.col("y"))).first()[0] - true) < 0.2


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_passages(rows, n):
    windows = defaultdict(set)
    own = {}
    for r in rows:
        if r.doc_id is not None and r.text is not None:
            ws = WORD.findall(r.text)
            for i in range(len(ws) - n + 1):
                w = tuple(ws[i : i + n])
                windows[w].add(r.doc_id)
                own[r.doc_id, i] = w
    out = []
    for first in (False, True):
        hits = sorted((d, i) for (d, i), w in own.items() if len(windows[w]) > 1 and (min(windows[w]) == d) == first)
        run = []
        for d, i in hits + [(None, None)]:
            if run and (d != run[-1][0] or i != run[-1][1] + 1):
                a, b = run[0][1], run[-1][1] + n
                out.append((run[0][0], first, a, b, b - a, min(min(windows[own[x]]) for x in run)))
                run = []
            run.append((d, i))
    return Counter(out)


@pytest.mark.parametrize(("n", "k", "rows_a_task"), [(50, 16, None), (12, 4, None), (12, 4, 40)])
def test_passages_match_brute_force(docs, rows, n, k, rows_a_task, monkeypatch):
    if rows_a_task:  # runs inside a task's range, at its ends and over several tasks
        monkeypatch.setattr(suffixes, "ROWS_A_TASK", rows_a_task)
        monkeypatch.setattr(suffixes, "STRETCHES_A_TASK", 5)
    assert Counter(tuple(r) for r in suffixes.passages(docs, n, k).collect()) == brute_passages(rows, n)


@pytest.mark.parametrize("rows_a_task", [None, 30])
def test_matches_that_a_nearer_neighbour_hides(made, spark, monkeypatch, rows_a_task):
    """Documents share words to the right with one, to the left with another, and the longer match to the right comes first in order."""
    if rows_a_task:
        monkeypatch.setattr(suffixes, "ROWS_A_TASK", rows_a_task)
        monkeypatch.setattr(suffixes, "STRETCHES_A_TASK", 4)
        monkeypatch.setattr(suffixes, "ENDS_HELD", 0)
    core = made.prose(9).split()
    left, right = ([made.prose(14).split() for _ in range(3)] for _ in range(2))
    texts = []
    for a in range(15):
        for b in range(0, 15, 2):
            one, two = made.rng.randrange(3), made.rng.randrange(3)
            words = made.prose(20).split() + left[one][14 - a :] + core + right[two][:b] + made.prose(20).split()
            texts.append(" ".join(words))
    texts += [" ".join(core * 8), texts[5], texts[5], f"{texts[9]} {texts[9]}"]
    made.rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(tuple(r) for r in suffixes.passages(df, 12, 4).collect()) == brute_passages(df.collect(), 12)


def test_equal_windows_are_told_apart_by_words(monkeypatch):
    """With fingerprints that are all alike, words alone decide."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 300).astype(np.uint64)
    at = np.arange(296)
    want = len({tuple(words[k : k + 5]) for k in at})
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(suffixes.Prefixes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
        order, new = suffixes.equal_windows(words, at, 5)
        assert sorted(order) == list(at) and new.sum() == want
        assert all(new[k] == (tuple(words[order[k] : order[k] + 5]) != tuple(words[order[k - 1] : order[k - 1] + 5])) for k in range(1, len(at)))


def without_repeats(rows, n):
    """Words of each text that are in no window which an earlier text has, texts in order of their key."""
    seen, owner = {}, {}
    for key, text in rows:
        ws = WORD.findall(text)
        for i in range(len(ws) - n + 1):
            owner.setdefault(tuple(ws[i : i + n]), key)
            seen.setdefault(key, []).append((i, tuple(ws[i : i + n])))
    out = {}
    for key, text in rows:
        gone = {j for i, w in seen.get(key, []) if owner[w] != key for j in range(i, i + n)}
        out[key] = [w for j, w in enumerate(WORD.findall(text)) if j not in gone]
    return out


def test_cut_texts_repeat_nothing(docs, rows):
    cut = suffixes.deduplicated(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    after = cut.collect()
    want = without_repeats(sorted({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None}), 50)
    assert any(len(want[r.doc_id]) < len(WORD.findall(r.text or "")) for r in rows if r.doc_id is not None)
    for r in after:
        if r.doc_id is not None:
            assert WORD.findall(r.text or "") == want[r.doc_id], r.doc_id
    before = {r.doc_id: r for r in rows}
    for r in after:
        assert (r.text == before[r.doc_id].text and r.n_chars == before[r.doc_id].n_chars) or r.n_chars == len(r.text)


def test_texts_that_share_an_id_are_judged_each_by_itself(made, spark):
    """Stages of the pipeline on two texts under one id, on texts without an id, and on an empty table."""
    passage, own = made.prose(60), [made.prose(90) for _ in range(6)]
    twin = own[1].split()
    twin[44] = "changed"
    rows = [(1, own[0]), (2, own[1]), (5, f"{own[2]} {passage}"), (5, " ".join(twin)), (7, f"{passage} {own[3]}"), (None, own[4]), (None, f"{own[5]} {passage}"), (None, own[4]), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("_rows", F.lit("clash")).withColumn("class", F.lit(1))
    kept = minhash.representatives(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([r for r in rows if r[1] != " ".join(twin) and r != (None, own[4])] + [(None, own[4])])
    cut = suffixes.deduplicated(df).collect()
    assert Counter(r.doc_id for r in cut) == Counter(r[0] for r in rows)
    texts = [r.text for r in cut]
    assert sum(passage in (t or "") for t in texts) == 1 and f"{passage} {own[3]}" in texts  # 7 is the only one of them with an id of its own
    assert {own[0], own[1], own[4], own[2] + " ", own[5] + " ", " ".join(twin)} <= set(texts)
    junk = " | ".join(made.prose(60).split())
    train = [(k, made.prose(60) if k % 2 else " | ".join(made.prose(50).split())) for k in range(100, 400)]
    mixed = spark.createDataFrame([*train, (3, junk), (3, own[0]), (None, junk), (None, own[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 400)], "doc_id long, quality int")
    ok = {(r.doc_id, r.text) for r in quality.accepted(mixed, labels).collect()}
    assert (3, own[0]) in ok and (None, own[1]) in ok and (3, junk) not in ok and (None, junk) not in ok
    for stage in (minhash.representatives, suffixes.deduplicated, mixing.mixed_documents, lambda d: quality.accepted(d, labels)):
        full = df.withColumn("source", F.lit("s"))
        assert stage(full.limit(0)).count() == 0 and stage(full.limit(0)).columns == full.columns


def test_packing(docs, rows):
    path, ranks = tokenizer_paths()
    plain = packing.Encoder(path)
    got = packing.pack_documents(docs, path, ranks).collect()
    want = Counter()
    for r in rows:
        ids = np.frombuffer(plain.plain(r.text or ""), "<u4").tolist() + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids), 2048), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("scale", [1, 50])
def test_plan_keeps_every_piece_and_wastes_little(made, scale):
    h = Counter(min(2048, int(made.rng.expovariate(1 / 500)) + 1) for _ in range(3000))
    h = {n: c * scale for n, c in h.items()}
    groups = packing.plan(h)
    used = Counter()
    for form, c in groups:
        assert sum(form) <= 2048
        for n in form:
            used[n] += c
    assert used == Counter(h)
    assert sum(c for _, c in groups) <= 1.005 * sum(n * c for n, c in h.items()) / 2048 + 1
    assert packing.plan({}) == []


def test_encoders_agree(made):
    path, ranks = tokenizer_paths()
    e = packing.Encoder(path, ranks)
    for t in made.texts() + ["a  b   c \n\n d", " x́ é'S 12ab", " wide", "\x85\x1f", "😀 ok", "don't 'LL"]:
        assert e.encode(t or "") == e.plain(t or ""), t


def test_encoder_is_the_tokenizer_file(made):
    from tokenizers import Tokenizer

    path, ranks = tokenizer_paths()
    file = Tokenizer.from_file(path)
    for e in (packing.Encoder(path, ranks), packing.Encoder(path)):
        for t in [*made.texts(), "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "名 <|endoftext|>", "<|endoftext|", "<| endoftext |>"]:
            assert np.frombuffer(e.encode(t or ""), "<u4").tolist() == file.encode(t or "", add_special_tokens=False).ids, t


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3.0 * sizes[s] for s in over}
    want = {s: capped.get(s, level * weight[s]) for s in order}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert sum(taken.values()) <= total
    most = {s: max([r.size for r in got if r.source == s]) for s in order}
    for s in order:
        assert abs(taken[s] - want[s]) <= max(most.values())
    key = lambda rs: Counter((r.doc_id, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(7)).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(taken.values())


def test_media_round_trip(docs, rows):
    got = media.media(docs, with_rgb=True).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        b = (r.text or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        h, w = map(int, r.feature.split("x")[:2])
        assert len(r.rgb) == h * w * 3 and h * w * 3 >= r.payload_bytes


def natural_jpeg(coefficients, width, height, factors, restart=0):
    """Another writer of progressive files: natural values, DC and AC in several scans, bit by bit, by fixed-length codes."""
    symbols = sorted({*range(16), *(r << 4 | s for r in range(16) for s in range(11)), *(n << 4 for n in range(15))})
    codes = {s: format(k, "08b") for k, s in enumerate(symbols)}
    body = bytes([0, 0, 0, 0, 0, 0, 0, len(symbols), *[0] * 8, *symbols])
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0] + [1] * 64)), media._segment(0xC4, b"\x00" + body), media._segment(0xC4, b"\x10" + body)]
    out.append(media._segment(0xC2, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(factors)]) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(factors))))
    if restart:
        out.append(media._segment(0xDD, restart.to_bytes(2, "big")))

    def value(x):
        n = abs(x).bit_length()
        return n, format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""

    def scan(ids, first, last, refine, low, units):
        parts, bits = [], ""
        for k, unit in enumerate(units):
            if restart and k and k % restart == 0:
                parts.append(bits)
                bits = ""
            if not bits:
                before = dict.fromkeys(ids, 0)
            for c, b in unit:
                x = coefficients[c][b]
                if first == 0:
                    if refine:
                        bits += str(x[0] >> low & 1)
                    else:
                        d = (x[0] >> low) - before[c]
                        before[c] = x[0] >> low
                        n, m = value(int(d))
                        bits += codes[n] + m
                    continue
                shifted = [int(abs(int(q)) >> low) * (1 if q > 0 else -1) for q in x]
                if not refine:
                    run, tail = 0, max([j for j in range(first, last + 1) if shifted[j]], default=first - 1)
                    for j in range(first, tail + 1):
                        if not shifted[j]:
                            run += 1
                            continue
                        while run > 15:
                            bits += codes[0xF0]
                            run -= 16
                        n, m = value(shifted[j])
                        bits += codes[run << 4 | n] + m
                        run = 0
                    if tail < last:
                        bits += codes[0]
                else:
                    known = [abs(int(q)) >> (low + 1) for q in x]
                    tail = max([j for j in range(first, last + 1) if shifted[j] and not known[j]], default=first - 1)
                    run, held = 0, ""
                    for j in range(first, tail + 1):
                        if known[j]:
                            held += str(abs(int(x[j])) >> low & 1)
                        elif not shifted[j]:
                            run += 1
                            if run == 16:
                                bits += codes[0xF0] + held
                                run, held = 0, ""
                        else:
                            bits += codes[run << 4 | 1] + ("1" if x[j] > 0 else "0") + held
                            run, held = 0, ""
                    rest = "".join(str(abs(int(x[j])) >> low & 1) for j in range(tail + 1, last + 1) if known[j])
                    if tail < last:
                        bits += codes[0] + held + rest
        parts.append(bits)
        data = b""
        for k, p in enumerate(parts):
            data += media._coded(np.array(list(p), np.uint8)) + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"")
        out.append(media._segment(0xDA, bytes([len(ids), *(q for c in ids for q in (c + 1, 0)), first, last, refine << 4 | low])) + data)

    def order(c):
        a, b = factors[c]
        return [[(c, y * wide * a + x)] for y in range(-(-height * b // (8 * v))) for x in range(-(-width * a // (8 * h)))]

    together = [[(c, (y * b + j) * wide * a + x * a + i) for c, (a, b) in enumerate(factors) for j in range(b) for i in range(a)] for y in range(high) for x in range(wide)]
    ids = list(range(len(factors)))
    units = together if len(ids) > 1 else order(0)
    scan(ids, 0, 0, 0, 1, units)
    for c in ids:
        scan([c], 1, 5, 0, 2, order(c))
        scan([c], 6, 63, 0, 2, order(c))
        scan([c], 1, 63, 2, 1, order(c))
        scan([c], 1, 63, 1, 0, order(c))
    scan(ids, 0, 0, 1, 0, units)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(("factors", "restart"), [([(1, 1)], 0), ([(1, 1)] * 3, 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(1, 1)] * 3, 2)])
def test_decoder_reads_natural_progressive_files(factors, restart):
    rng = np.random.default_rng(3)
    width, height = 32, 48
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    wide, high = width // (8 * h), height // (8 * v)
    coefficients = []
    for a, b in factors:
        x = rng.integers(-60, 60, (wide * a * high * b, 64)) * (rng.random((wide * a * high * b, 64)) < 0.3)
        coefficients.append(x)
    d = media.Decoder(natural_jpeg(coefficients, width, height, factors, restart))
    for c, x in enumerate(coefficients):
        assert (d.coefficients[c + 1] == x).all(), c
    assert d.rgb().shape == (height, width, 3)


def test_transform_is_the_inverse():
    flat = np.zeros(64, np.float32)
    flat[0] = 80
    assert np.allclose(media.IDCT @ flat, 10)
    assert np.allclose(media.IDCT.T @ media.IDCT, np.eye(64), atol=1e-5)


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.2, 8).tolist()) for k in range(700)]
    rows += [(k, [0.5] * 8) for k in range(700, 1100)]
    rows += [(1100, None), (1120, [0.1, None] * 4), (1140, [float("nan")] * 8), (1160, [float("inf")] * 8), (1180, []), (None, [0.1] * 8), (1200, [0.1] * 5), (1203, [0.2] * 5), rows[20], (1220, [300000.0] * 8)]
    rows += [(40, [0.3] * 8), (41, [0.4] * 8)]  # other vectors under ids that are there already
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


@pytest.mark.parametrize("size", [16_384, 100])
def test_top_k_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "SHARD_ROWS", size)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    df, rows = vectors(spark)
    good = {(i, tuple(np.floor(64 * np.array(v)).tolist())) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, x in good:
        if q % 20 == 0:
            scores = sorted((-int(np.dot(x, y)) if x else 0, i) for i, y in good if i != q and len(y) == len(x))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = topk.top_k(df).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert len({r.query_row for r in got if r.query_id == 40}) == 2


def test_search_of_clustered_vectors_meets_few_shards(spark, monkeypatch):
    """Shards have tight boxes, so that most pairs of block and shard are never sent; what is found is whole."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.03, (6000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    shards, pairs = [], []
    send, plain = topk.wanted, topk.materialise

    def count(blocks, boxes, best, k, turn):
        out = plain(send(blocks, boxes, best, k, turn), "counted")
        pairs.append(out.where("leaf >= 0").count())
        shards[:] = shards or [blocks.count(), sum(map(len, boxes.values()))]  # later turns get the blocks that aren't settled
        return out

    monkeypatch.setattr(topk, "wanted", count)
    got = topk.top_k(df).collect()
    assert sum(pairs) < 0.4 * shards[0] * shards[1], (pairs, shards)
    v = np.floor(64 * x)
    score = v[::20] @ v.T
    for q in range(0, 6000, 20):
        own = sorted((-int(s), i) for i, s in enumerate(score[q // 20]) if i != q)[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in own]


def test_search_reaches_every_shard(spark, monkeypatch):
    """Vectors without structure over more shards than 64 turns of one would reach."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "MOST_AT_ONCE", 1)
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (1200, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert sum(map(topk.at_once, range(20))) > 1200 / 8 > 64
    got = topk.top_k(df, query_every=100).collect()
    v = np.floor(64 * x)
    for q in range(0, 1200, 100):
        want = sorted((-int(s), i) for i, s in enumerate(v[q] @ v.T) if i != q)[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in want]


def largest_windows(df, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_repeated_rows_are_no_hot_bucket(spark, monkeypatch):
    """A third of all rows equal, without an id: in packing and in mixing they are dealt over many buckets."""
    monkeypatch.setattr(mixing, "SALTS", 16)
    n = 9000
    third = F.col("id") % 3 == 0
    df = spark.range(n).select(F.when(~third, F.col("id")).alias("doc_id"), F.when(third, "same words each").otherwise(F.concat(F.lit("some words "), "id")).alias("text"), F.when(third, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source")).repartition(6)
    kept, seen = mixing.running, []

    def watched(rows, keys, bucket, order, value, name):
        seen.append(largest_windows(rows, [*keys, bucket]))
        return kept(rows, keys, bucket, order, value, name)

    monkeypatch.setattr(mixing, "running", watched)
    got = mixing.mix(df).collect()
    assert seen[0] < 60 and len(got) == n, seen
    counts = Counter((r.doc_id, r.size, r.taken) for r in got)
    assert counts == Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(df.repartition(3).orderBy("source")).collect())
    hot = [r for r in got if r.doc_id is None]
    assert len(hot) == n // 3 and abs(sum(r.taken for r in hot) - hot[0].target) <= 9
    ranked, plain = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda d, name, *a: ranked.append(out := plain(d, name, *a)) or out)
    packed = packing.pack_documents(df, *tokenizer_paths()).collect()
    assert len(packed) == n and len({(r.sequence_id, r.offset) for r in packed}) == n
    salted = ranked[-1].withColumn("_salt", F.pmod(F.xxhash64("_copy"), F.lit(packing.SALTS)))
    assert largest_windows(salted, ["length", "_salt"]) < 60


def test_the_budget_is_used_to_the_last_document(spark):
    """Documents larger than their source's target, and times to finish far beyond 2, leave no room for another one."""
    for sizes in ([("a", 600), *[("b", 1)] * 300, *[("c", 1)] * 300], [("a", 4000), ("a", 3900), *[("b", 7)] * 40, ("c", 900), *[("d", 1)] * 90]):
        df = spark.createDataFrame([(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
        got = mixing.mix(df).collect()
        total, taken = sum(n for _, n in sizes), sum(r.taken for r in got)
        left = [r.size for r in got if r.taken < 3 * r.size]
        assert taken <= total and (not left or total - taken < max(left)), (taken, total)
    finish = [0.0, 0.5, 1.99, 2.0, 2.5, 3.0, 700.0, 1e9, 1e15]
    slots = [r[0] for r in spark.createDataFrame([(x,) for x in finish], "x double").select(mixing.slot_of(F.col("x"), 10)).collect()]
    assert slots == sorted(slots) and slots[2] < slots[3] and len(set(slots)) == len(slots)


def test_license_scan(spark):
    t = licenses.TEMPLATES
    text = "Foo bar baz.\n" + t["Apache-2.0"].lower() + " (the thing)\n" + "word " * 300 + t["MIT-grant"].replace("obtaining", "getting") + " end"
    df = spark.createDataFrame([(1, text), (2, "nothing of the kind under the sun"), (3, None), (4, ""), (5, t["CC-BY-4.0"]), (5, t["MIT"]), (None, t["GPL-3.0"])], "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan(df).collect()}
    assert set(got) == {(1, "Apache-2.0"), (5, "CC-BY-4.0"), (5, "MIT"), (None, "GPL-3.0")}
    assert got[1, "Apache-2.0"].containment == 1.0 and got[1, "Apache-2.0"].word <= 3
    low = {(r.doc_id, r.license) for r in licenses.scan(df, contained=0.6).collect()}
    assert (1, "MIT-grant") in low
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).count() == 0


def test_bands_retrieve_and_containment_verifies(made, spark, monkeypatch):
    """Long and very short templates, in a table; occurrences with changed words; without bands nothing is found."""
    long = [made.prose(400).split() for _ in range(30)]
    templates = spark.createDataFrame([(f"t{k}", " ".join(w)) for k, w in enumerate(long)] + [("short", "All rights reserved"), ("one", "Unlicensed")], "license string, body string")
    rows, want = [], set()
    for k, w in enumerate(long):
        changed = list(w)
        for at in range(0, 400, 40 if k % 2 else 8):
            changed[at] = "other"
        rows.append((k, f"{made.prose(30 * k)} {' '.join(changed)} {made.prose(50)}"))
        if k % 2:
            want.add((k, f"t{k}"))  # ten changed words leave 350 of 396 shingles, fifty hardly any
    rows += [(100, "x (c) 2020. ALL RIGHTS\nRESERVED."), (101, "all rights are reserved"), (102, "it is unlicensed")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(df, templates).collect()} == want | {(100, "short"), (102, "one")}
    monkeypatch.setattr(licenses, "HELD_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = licenses.scan(df, templates)
        assert {(r.doc_id, r.license) for r in joined.collect()} == want | {(100, "short"), (102, "one")}
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    with pytest.raises(ValueError, match="nothing"):
        licenses.scan(df, {"nothing": "..."})
    monkeypatch.setattr(licenses, "least_of", lambda hashes, seed: F.lit(1).cast("long") + seed)
    assert licenses.scan(df, templates).count() == 0


def test_licenses_in_a_very_long_text(made, spark):
    """600 templates of 2,000 words; a text of 100,000 words holds three of them, and one of 25,000 takes about a quarter of its time."""
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "fi", "gu", "ke", "lo") for b in range(500)]
    body = lambda n: " ".join(made.rng.choices(vocabulary, k=n))
    bodies = {f"t{k}": body(2000) for k in range(600)}
    templates = materialise(spark.createDataFrame(list(bodies.items()), "license string, body string").repartition(8), "templates")

    def took(n: int) -> float:
        text = " ".join([body(n // 3), bodies["t3"], bodies["t5"], body(n // 3), bodies["t599"], body(n - 2 * (n // 3) - 6000)])
        began = time.time()
        got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), templates).collect()
        assert {r.license for r in got} == {"t3", "t5", "t599"} and all(r.containment == 1.0 for r in got)
        return time.time() - began

    took(25_000)
    small, large = took(25_000), took(100_000)
    assert large < 5 * small, (small, large)


def test_sharding(docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    most = max(r["size"] for r in got)
    assert len(load) == 4 and max(load.values()) <= max(most, sum(load.values()) / 4) + most
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_spreads_null_and_repeated_ids(made, spark):
    """A third of all rows without an id, a third with one id, most of them equal: shards are still even, slots the same again."""
    own = [(k, made.prose(30)) for k in range(4000)]
    rows = own + [(None, own[k % 5][1]) for k in range(4000)] + [(-1, own[7][1])] * 4000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df.repartition(3)).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((k, zlib.crc32(t.encode())) for k, t in rows)
    load, by = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        by[r.shard].append(r.slot)
    assert len(load) == 16 and max(load.values()) < 1.02 * sum(load.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(Counter(r.virtual_slot for r in got).values()) < 30
    again = sharding.shard(df.orderBy(F.rand(5)).repartition(5)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    slots = {r.doc_id: r.virtual_slot for r in df.where("doc_id >= 0").select("doc_id", sharding.slot_of(F.col("doc_id")).alias("virtual_slot")).collect()}
    assert all(slots[r.doc_id] == r.virtual_slot for r in got if r.doc_id is not None and r.doc_id >= 0)


def test_slot_map_is_even_and_edited_little(made):
    sizes = [made.rng.randint(50, 150) for _ in range(sharding.SLOTS)]
    one = sharding.rebalance([k % 16 for k in range(sharding.SLOTS)], sizes, 16)
    load = np.bincount(one, weights=sizes)
    assert load.max() / load.min() < 1.01
    two = sharding.rebalance(one, sizes, 17)
    moved = [k for k in range(sharding.SLOTS) if one[k] != two[k]]
    assert sum(two[k] == 16 for k in moved) > 0.9 * len(moved)
    load = np.bincount(two, weights=sizes)
    assert load.max() / load.min() < 1.03 and len(moved) < sharding.SLOTS / 14
    assert sharding.rebalance(one, sizes, 16) == one
    less = sharding.rebalance(two, sizes, 11)
    load = np.bincount(less, weights=sizes)
    assert len(load) == 11 and load.max() / load.min() < 1.03
    assert sum(two[k] != less[k] for k in range(sharding.SLOTS)) < 1.2 * sum(shard >= 11 for shard in two)


def test_stored_map_is_read_edited_and_kept(made, spark, tmp_path, monkeypatch):
    """Runs over one stored map: the same again, grown records, more shards, fewer shards; rows are even and numbered each time."""
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    monkeypatch.setattr(sharding, "SLOTS", 512)
    path = f"file://{tmp_path}/map"
    monkeypatch.setattr(sharding.slotted, "__defaults__", (512,))
    rows = [(k, made.prose(20)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grown = spark.createDataFrame([(k, t + " more" * (40 if k % 9 == 0 else 0)) for k, t in rows], "doc_id long, text string")
    versions, before = [], None
    for table, shards in ((df, 8), (df, 8), (grown, 8), (grown, 9), (grown, 6)):
        got = sharding.shard(table, shards, path).collect()
        load, places = Counter(), defaultdict(list)
        for r in got:
            load[r.shard] += r["size"]
            places[r.shard].append(r.slot)
        assert set(load) == set(range(shards)) and max(load.values()) < 1.05 * min(load.values())
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        version = {r.map_version for r in got}
        assert len(version) == 1
        versions += version
        now = {r.doc_id: (r.virtual_slot, r.shard) for r in got}
        if before:
            assert all(now[d][0] == before[d][0] for d in now)
            assert (sum(now[d] != before[d] for d in now) == 0) == (versions[-1] == versions[-2])
        before = now
    assert versions[0] == versions[1] and len(set(versions)) == 4 and versions == sorted(versions)
    assert sharding.latest_map(spark, path)[0] == versions[-1]
    assert [r[0] for r in spark.read.parquet(path).groupBy("version").count().select("count").distinct().collect()] == [512]


def test_archive(spark):
    page = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a b", page), (3, "u", page), (9, None, page), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", page), (3, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    got = Counter(tuple(r) for r in warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != 3
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    assert warc.archive(df.limit(0)).count() == 0


def test_classifier_learns_and_keeps_out_of_the_held_out(made, spark):
    texts = [made.prose(60) if k % 3 else " | ".join(made.prose(40).split()) for k in range(600)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "x y"), (900, None), (901, ""), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in range(600):
        assert by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= by[k].score <= 1 and by[k].predicted == int(by[k].score >= 0.3)
    held = [k for k in range(600) if by[k].held_out]
    assert np.mean([by[k].predicted == int(k % 3 > 0) for k in held]) > 0.97
    assert by[900].score == by[901].score
    # labels of held-out rows make no difference
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(df, flipped).collect()}
    assert all(abs(again[k] - by[k].score) < 1e-9 for k in range(600))
    assert quality.classify(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


def test_empty_tables(docs):
    none = docs.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert suffixes.passages(none).count() == 0
    assert packing.pack_documents(none, *tokenizer_paths()).count() == 0
    assert mixing.mix(none).count() == 0
    assert media.media(none).count() == 0
    assert topk.top_k(docs.sparkSession.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def shuffled_bytes(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    lists, none = spark._jvm.java.util.ArrayList, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages, total = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, none, lists()).iterator(), 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_texts_outside_families_are_not_shuffled(spark, made, tmp_path):
    texts = [made.prose(300) for _ in range(400)]
    path = str(tmp_path / "texts.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    named = minhash.named(docs, "doc_id", "text")
    reps = spark.createDataFrame([(k, r.key) for k, r in enumerate(named.where("id % 40 = 0").select("key").collect())], "class long, key long")
    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the keys are many
    try:
        before = shuffled_bytes(spark)
        got = minhash.class_texts(docs, reps, "doc_id", "text").collect()
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", told)
    assert sorted(r.t for r in got) == sorted(texts[::40])
    assert moved < sum(map(len, texts)) / 5


def test_likely_has_all_that_is_wanted(spark, monkeypatch):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), "id").unionByName(spark.sql("SELECT CAST(NULL AS long) key, -1L id"))
    wanted = rows.where("id % 10 = 0").select("key")
    for most in (27, 15):
        monkeypatch.setattr(common, "MARK_BITS", most)
        got = {r.id for r in common.likely(rows, wanted, "key").collect()}
        assert {k for k in range(0, 20_000, 10)} <= got and len(got) < (2_500 if most == 27 else 6_000) and -1 not in got
    assert common.likely(rows, wanted.limit(0), "key").count() == 0
