"""op3, op5, op6 against brute force; odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import simhash, substring_dedup, suffix_dedup
from worklens.llm.components import least_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_bytes(rows, size=50):
    first = {}
    order = lambda i: (i is None, i)
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if order(first[b[p : p + size]]) < order(i):
                gone[p : p + size] = [True] * size
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, size=50):
    first, order = {}, lambda i: (i is None, i)
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in sorted(words, key=lambda r: order(r[0])):
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if order(first[tuple(w[p : p + size])]) < order(i):
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def pieced(rng, base, join, least=0):
    parts = []
    for _ in range(rng.randint(0, 4)):
        b = rng.choice(base)
        x = rng.randint(0, max(0, len(b) - 1))
        parts.append(b[x : x + rng.randint(1, 160)])
    return join(parts)


@pytest.fixture(scope="module")
def byte_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 400))) for _ in range(10)]
    rows = [(i, pieced(rng, base, "".join) if i % 17 else None) for i in range(80)]
    rows += [(500, "a" * 300), (501, "a" * 120), (502, "b" + "a" * 49), (503, "b" + "a" * 50 + "c"), (504, "x" * 49), (505, "x" * 49), (506, "x" * 51), (507, ""), (None, "a" * 60), (None, "q" * 60)]
    return rows + [(3, rows[3][1]), (900, "".join(rng.choice("abc ") for _ in range(200_000)) + rows[3][1])]


@pytest.fixture(scope="module")
def word_rows():
    rng = random.Random(6)
    base = [[rng.choice(["u", "v", "é", *[f"z{j}" for j in range(30)]]) for _ in range(rng.randint(0, 300))] for _ in range(8)]
    space = lambda parts: "".join(w + rng.choice([" ", "\n", "  ", " x "]) for p in parts for w in p)
    return [(i, pieced(rng, base, space) if i % 13 else None) for i in range(80)] + [(4, None), (None, " ".join(base[1])), (700, " \n ")]


def test_suffix_dedup(spark, byte_rows):
    df = spark.createDataFrame(byte_rows, "doc_id long, text string").withColumn("spans", F.lit(1))  # a clashing name
    got = suffix_dedup.removed_spans(df).collect()
    have = sorted(((r.id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert have == brute_bytes(byte_rows)


@pytest.mark.parametrize("size", [20, 21, 33])
def test_suffix_dedup_of_other_lengths(spark, byte_rows, size):
    rows = byte_rows[:90]
    got = suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_len=size).collect()
    have = sorted(((r.id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert have == brute_bytes(rows, size)


def test_interval_tree():
    # suffixes: three share 60 bytes, of which two share 80; only different left neighbours make a repeat
    lcp, docs = np.array([0, 60, 80]), np.array([4, 2, 7])
    assert suffix_dedup.intervals(lcp, docs, np.array([False, True, True]), 50) == [(1, 2, 80, 2), (0, 2, 60, 2)]
    assert suffix_dedup.intervals(lcp, docs, np.array([False, True, False]), 50) == [(0, 2, 60, 2)]
    assert suffix_dedup.intervals(np.array([0, 49]), np.array([1, 2]), np.array([True, True]), 50) == []


def test_suffix_stage(spark, byte_rows):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in byte_rows]
    out = suffix_dedup.suffix_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == len(rows)
    assert out.filter("text is null").count() == sum(t is None for _, t in byte_rows)
    assert out.filter("n_chars <> length(text)").count() == 0


def test_substring_dedup(spark, word_rows):
    got = substring_dedup.removed_words(spark.createDataFrame(word_rows, "doc_id long, text string")).collect()
    have = sorted(((r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert have == brute_words(word_rows)


def test_words_that_differ_in_one_pattern(spark):
    # two words in Thue-Morse order have equal polynomial hashes modulo 2^64
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    words = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([one, *words])), (2, " ".join([two, *words])), (3, " ".join(["x" if b else "y" for b in bits[:64]])), (4, " ".join(["y" if b else "x" for b in bits[:64]]))]
    got = substring_dedup.removed_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute_words(rows)


def test_runs():
    x = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    for size in (1, 2, 20, 31, 50, 64):
        h = substring_dedup._runs(x, size).tolist()
        runs = [tuple(x[i : i + size].tolist()) for i in range(len(x) - size + 1)]
        assert len(h) == len(runs) and len(set(zip(h, runs, strict=True))) == len(set(h)) == len(set(runs))
    assert len(substring_dedup._runs(x[:10], 50)) == 0


def test_cover():
    c, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removed_spans(none).count() == substring_dedup.removed_words(none).count() == simhash.near_duplicates(none).count() == 0


def components(ids, fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, x in zip(ids, range(len(fps)), strict=True):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [least.get(find(x)) for x in range(len(fps))]


def test_simhash(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):  # near copies
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("\t".join(base).upper() if rng.random() < 0.3 else " \n".join(base))
    texts += [None, "", " ", "one", "one", "one two", "É é", "x " * 20_000]
    rows = [(None if i % 29 == 7 else i, t) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))).collect()
    # an independent fingerprint: words and shingles by regular expression, bit by bit
    import xxhash

    def plain(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        return simhash.text_fingerprint([xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s])

    fps = [plain(t) for _, t in rows]
    # a row without an id has the component of its own fingerprint only
    named = [(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None]
    of = dict(zip([f for _, f in named], components(*zip(*named, strict=True), 3), strict=True))
    want = [of.get(f) for f in fps]
    assert sorted(((r.id, int.from_bytes(r.fp), r.component_id) for r in got), key=str) == sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=str)


@pytest.mark.parametrize("crowd", [4, 4_000_000])
def test_links_find_all_near_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            x = int(b)
            for _ in range(rng.integers(1, 5)):
                x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fps = sorted(fps)
    raw = np.array(fps, np.uint64).astype(">u8").view(np.uint64)
    key = simhash._segments(raw, 32, 2)
    edges = set()
    for j in range(2):
        a, b = simhash._link(np.ones(len(fps), bool), raw[:, None], key[:, j], 32, 3)
        edges |= set(zip(a.tolist(), b.tolist(), strict=True))
    ids = list(range(len(fps)))
    df = least_labels(spark.createDataFrame([(i, i) for i in ids], "node long, label long"), spark.createDataFrame(sorted(edges) or [(0, 0)], "a long, b long"))
    got = {r.node: r.label for r in df.collect()}
    assert [got[i] for i in ids] == components(ids, fps, 3)


@pytest.mark.parametrize("room", [1, 1 << 20])
def test_copies_of_a_fingerprint_do_not_grow_with_their_number(spark, monkeypatch, room):
    monkeypatch.setattr(simhash, "ROUND", room)
    rng = np.random.default_rng(5)
    plan = {"words": 2, "width": 22, "count": 5, "radius": 24}
    bits = rng.integers(0, 2, (60, 128))
    bits = np.concatenate([bits, bits ^ (rng.random((60, 128)) < 0.06), bits ^ (rng.random((60, 128)) < 0.12)]).astype(np.uint8)
    fps = spark.createDataFrame([(i, np.packbits(b).tobytes()) for i, b in enumerate(bits)], "id long, fp binary")
    near = [(i, j) for i in range(len(bits)) for j in range(i) if (d := bits[i] ^ bits[j]).sum() <= 24 and d[:110].reshape(5, 22).sum(axis=1).min() <= 1]
    nodes = spark.range(len(bits)).select(F.col("id").alias("node"), F.col("id").alias("label"))
    want, dealt = least_labels(nodes, spark.createDataFrame(near, "a long, b long")).collect(), []
    for n in (180, 3_000_000):
        kind, whole = type(fps), type(fps).mapInArrow
        monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema, whole=whole: dealt.append(whole(df, f, schema)) or dealt[-1])
        pairs = simhash.links(fps, n=n, **plan)
        monkeypatch.setattr(kind, "mapInArrow", whole)
        assert sorted(least_labels(nodes, pairs).collect()) == sorted(want) and len({r.label for r in want}) < 170
        assert sum(len(r.ids) // 8 for d in dealt for r in d.collect()) == 180 * 2 * 5 and len(dealt) == (5 if room == 1 else 1)
        dealt.clear()


def test_wide_links_near_texts(spark):
    rng = random.Random(4)
    rows, pairs = [], []
    for i in range(80):
        w = [f"t{rng.randrange(5000)}" for _ in range(200)]
        near = list(w)
        near[rng.randrange(200)] = "other"  # Jaccard about 0.95
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
        pairs.append((2 * i, 2 * i + 1))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").select("doc_id").collect()}
    assert {a for a, _ in pairs} <= kept and sum(b in kept for _, b in pairs) <= 2


def test_components_of_a_chain(spark):
    n = 200
    df = least_labels(spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("label")), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert df.select("label").distinct().collect()[0].label == 0 and df.count() == n


def jaccard_components(rows, similarity=0.8):
    """Least id of each row's component by all pairs of five-word shingle sets."""
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both and both / (len(shingles[a]) + len(shingles[b]) - both) >= similarity:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: rows[find(k)][0] for k, (i, _) in enumerate(rows)}


def test_stage_verifies_jaccard(spark):
    rng = random.Random(8)
    rows, around = [], []
    for i in range(300):
        w = [f"t{rng.randrange(9000)}" for _ in range(rng.choice([60, 200, 600]))]
        near, cut = list(w), rng.uniform(0.05, 0.18)  # the end goes: Jaccard 0.69 to 0.9
        n = int(len(w) * cut)
        near[len(w) - n :] = [f"o{rng.randrange(9000)}" for _ in range(n)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
        around.append(2 * i + 1)
    want = jaccard_components(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").select("doc_id").collect()}
    true = {i for i in around if want[i] != i}
    assert 60 < len(true) < 240
    assert set(around) - true <= kept  # nothing under 0.8 goes
    assert len(true & kept) <= 0.03 * len(true)  # the stated recall is 0.99


@pytest.mark.parametrize("block", [3, 1024])
def test_verified_links_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_SETS", block)
    rng = random.Random(9)
    w = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(40):  # chains: each member changes a few words of the one before
        at = rng.randrange(150)
        new = [f"n{i}_{k}" for k in range(rng.choice([1, 4, 30]))]
        w = (w[:at] + new + w[at + len(new) :])[:150]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame([(i, simhash._set_key(simhash.shingle_set(t, 5)), 0, simhash.shingle_set(t, 5).tobytes()) for i, t in rows], "id long, key binary, coarse long, hashes binary")
    nodes = spark.createDataFrame([(i, i) for i, _ in rows], "node long, label long")
    want = jaccard_components(rows)
    assert {r.node: r.label for r in least_labels(nodes, simhash.verified_links(df, 0.8)).collect()} == want
    assert 1 < len(set(want.values())) < 40
