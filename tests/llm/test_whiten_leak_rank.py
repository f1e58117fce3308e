"""op11, op12, op13 against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import decontamination, lexical, whitening

# ---- op11


def vectors(n=200, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(i, rows[0][1]) for i in range(1000, 1080)] + [(3, rows[3][1]), (None, rows[4][1]), (2000, None), (2001, [float("nan")] * d), (2002, [None] * d), (2003, [float("inf")] * d), (2004, [1.0]), (2005, [])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "id": F.lit("a"), "w": F.lit(0)})


def test_whitening(spark):
    rows = vectors()
    scaled = whitening.scaled(frame(spark, rows))
    model = whitening.fit(scaled, 5)
    out = whitening.whiten(scaled, model)
    x = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v] + [102_400 * 0 + 0] * (12 - len(v))) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    n, m = len(x), np.array([v for _, v in x], np.float64)
    sums = [sum(v[k] for _, v in x) for k in range(12)]
    assert model.n == n and list(model.sums) == sums
    cov = np.cov(m.T, bias=True)
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1][:5], units[:, ::-1][:, :5].T
    assert np.allclose(model.eigenvalues, values, rtol=1e-9) and model.trace == pytest.approx(np.trace(cov), rel=1e-12)
    assert np.allclose(np.abs(np.sum(model.components * units, axis=1)), 1, atol=1e-9)
    want = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in x)
    got = out.collect()
    assert sorted((str(r.id), r.deviation) for r in got) == want
    assert whitening.identity_error(out, 5) < 1e-9
    by = {r.id: r.w for r in got}
    for i, v in x[:20]:
        w = (np.array(v) - m.mean(axis=0)) @ model.components.T / np.sqrt(model.eigenvalues)
        assert np.allclose(by[i], w, atol=1e-9)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        scaled = whitening.scaled(frame(spark, rows))
        model = whitening.fit(scaled)
        out = whitening.whiten(scaled, model)
        assert len(model.eigenvalues) == 0 and whitening.identity_error(out, 0) == 0.0
        assert all(r.w == [] for r in out.collect())
    line = whitening.fit(whitening.scaled(frame(spark, [(i, [float(i), float(2 * i), 0.0]) for i in range(5)])))
    assert len(line.eigenvalues) == 1 and np.allclose(np.abs(line.components[0]), np.array([1, 2, 0]) / math.sqrt(5))


def test_whitening_of_large_entries(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [1e12, 3.0])]
    scaled = whitening.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    model = whitening.fit(scaled)
    x = {r.id: r.x for r in scaled.collect()}
    assert x[3][0] == 1024 * 10**12 + 100_000 and x[1][0] == (1 << 62) + 100_000
    assert list(model.sums) == [sum(v[k] for v in x.values()) for k in range(2)]
    got = {r.id: r.deviation for r in whitening.whiten(scaled, model).collect()}
    assert got == {i: min(sum((3 * v[k] - model.sums[k]) ** 2 for k in range(2)), 2**63 - 1) for i, v in x.items()}


@pytest.mark.parametrize("shape", [(1, 1), (6, 3), (9, 9), (33, 40)])
def test_factor_and_rotations(shape):
    a = np.random.default_rng(shape[0]).standard_normal(shape) * 10.0 ** -np.arange(shape[1]).clip(0, 4)
    v = a @ a.T
    g = whitening.pivoted_cholesky(v)
    assert g.shape[1] == min(shape) and np.allclose(g @ g.T, v, atol=1e-12 * np.trace(v))
    r = whitening.jacobi(g)
    dots = r.T @ r
    assert np.allclose(dots, np.diag(np.diag(dots)), atol=1e-12 * np.trace(v)) and np.allclose(r @ r.T, v, atol=1e-12 * np.trace(v))


# ---- op12

WORDS = [f"w{i}" for i in range(60)] + ["é", "Ünd", "日本", "x1"]


def leaks(docs, items, window=10):
    """The same by plain loops."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    grams = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1)):
            if w:
                grams.setdefault(tuple(w[a : a + window]), set()).add(None if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for a in range(len(w) - size + 1):
                if (mine := grams.get(tuple(w[a : a + size]))) is not None:
                    hit.update(range(a, a + size))
                    found |= mine
        out.append((i, len(w), len(hit), sorted(found - {None})))
    return out


def texts(rng, n, most):
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "!\n"]) for _ in range(rng.randint(1, most))) for _ in range(n)]


def leak_tables(seed=0):
    rng = random.Random(seed)
    items = [(i, t) for i, t in enumerate(texts(rng, 25, 30))] + [(3, "w1 w2 w3"), (40, "W1"), (41, "é w3"), (None, "w5 w5"), (42, None), (43, ""), (44, "..."), (45, "unseen w1 w2"), (7, "w9 w9 w9")]
    body = texts(rng, 60, 200)
    for k in range(0, 60, 3):
        body[k] += " " + (items[k % 25][1]).upper().replace(" ", "\t")
    docs = list(enumerate(body)) + [(100 + i, "w1 " * 40 + "w9 w9 w9 w9") for i in range(40)] + [(5, body[5]), (5, body[6]), (None, body[3]), (None, body[3]), (200, None), (201, ""), (202, "?!"), (203, "w1"), (204, "ŵ1")]
    return docs, items


@pytest.mark.parametrize("most_bytes", [32 << 20, 1500])
def test_contamination(spark, most_bytes):
    docs, items = leak_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"w": F.lit(1), "doc": F.lit("x"), "key": F.lit(0), "items": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"passage": F.lit("p"), "item": F.lit(0)})
    got = [(r.id, r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(d, i, most_bytes=most_bytes).collect()]
    assert sorted(got, key=str) == sorted(leaks(docs, items), key=str)


def test_contamination_of_nothing(spark):
    docs, items = leak_tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert decontamination.contamination(d.filter("false"), i).count() == 0
    for none in (i.filter("false"), i.filter("text is null or text = ''")):
        got = decontamination.contamination(d, none).collect()
        assert len(got) == len(docs) and not any(r.n_hit or r["items"] for r in got)


def test_contamination_stays_in_the_jvm(spark):
    docs, items = leak_tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontamination.contamination(d, i)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")  # what a document without items carries


# ---- op13


def rank(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, b in bags:
            m = 10 + 90 * b.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in wanted if b[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("most_terms", [1 << 18, 40])
def test_ranked(spark, most_terms):
    docs, items = leak_tables(3)
    items = items + [(60, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"rare{i}" for i in range(90))), (60, "x1")]
    docs = docs + [(300 + i, f"rare{i} rare{i % 7} w1") for i in range(90)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "tf": F.lit(0), "score": F.lit(2), "rank": F.lit(3)}).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("p"), "item": F.lit(0)})
    got = lexical.ranked(d, i, most_terms=most_terms).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rank(docs, items), key=str)


def test_ranked_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.ranked(d, i).collect()] == [("1", 1, 1)] or lexical.ranked(d, i).collect() == []
    for x, y in ((d.filter("false"), i), (d, i.filter("false")), (d.filter("text is null"), i)):
        out = lexical.ranked(x, y)
        assert out.columns == ["item_id", "rank", "id", "score"] and out.count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = (("Ab1 é.. " * 500) + "c" * 300).encode()
    whole = lexical._counts(text)
    monkeypatch.setattr(lexical, "PIECE", 13)
    assert lexical._counts(text) == whole and whole["é".encode()] == 500


def test_masks_stop_early():
    """Groups under the k-th score are never evaluated, and nothing is lost by it."""
    rng = np.random.default_rng(0)
    n, terms = 3000, 70
    hold = rng.random((n, terms)) < np.linspace(0.01, 0.9, terms)
    tf = rng.integers(1, 9, (n, terms)) * hold
    weights = np.linspace(9000, 1, terms).astype(np.int64)
    doc, term = np.nonzero(tf)
    length = tf.sum(axis=1) + 1
    block = lexical.Block(length, hold.sum(axis=1), term, tf[doc, term], weights, n, int(length.sum()))
    m = 10 + 90 * length * n // int(length.sum())
    full = sum(weights[t] * np.where(tf[:, t] > 0, 10**9 * tf[:, t] // (1000 * tf[:, t] + 8 * m), 0) for t in range(terms))
    seen = []
    score, block.scores = block.scores, lambda rows, docs: seen.append(len(docs)) or score(rows, docs)
    docs, scores = block.best(np.arange(terms), 10, 1)
    want = sorted(zip((-full).tolist(), range(n), strict=True))[:10]
    assert sorted(zip((-scores).tolist(), docs.tolist(), strict=True))[:10] == want
    assert sum(seen) < n / 2
