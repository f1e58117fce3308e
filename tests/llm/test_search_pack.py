"""op1, op4, op7, op10 and the pipeline against brute force."""

import math
import os
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import ann, bitslice, packing, queries, warc

D = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def vectors(n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    for i in range(100, 160):
        rows[i] = (i, rows[100][1])  # one vector very often
    return rows + [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [None] * d), (1004, [float("inf")] + [1.0] * (d - 1)), (None, rows[0][1]), (5, rows[5][1])]


def fine(rows, zero=True):
    return {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or any(v))}


def test_nearest(spark):
    rows = vectors()
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)), F.col("vec_id") % 20 == 0, k=5)
    x = fine(rows, zero=False)
    hit = total = 0
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for qid in [i for i in x if i % 20 == 0]:
        cos = lambda i: x[i] @ x[qid] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[qid] @ x[qid]))
        want = sorted((i for i in x if i != qid), key=lambda i: (-round(cos(i), 12), i))[:5]
        mine = sorted(by[qid])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(m[2] == pytest.approx(cos(m[1]), abs=1e-12) for m in mine)
        hit += len({m[1] for m in mine} & set(want))
        total += 5
    assert hit / total >= 0.95


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(1, 1)]
    assert ann.nearest(df.filter("false"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("noise", [1e-4, 1e-3])
def test_nearest_among_near_copies(spark, noise):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + noise * rng.standard_normal((500, 64))  # a third of the rows
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 30 == 0).toPandas()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for qid in range(0, 1500, 30):
        s = -np.linalg.norm(x - x[qid], axis=1)
        s[qid] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & set(got[got.query_id == qid].vec_id))
    assert hit >= 0.9 * 5 * 50, hit


@needs_data
def test_nearest_recall(spark):
    got = ann.op1_nn_descent_search(spark, D).toPandas()
    rows = duckdb.sql(f"select vec_id, embedding from '{D}/embeddings.parquet' order by 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for qid in ids[ids % 50 == 0]:
        s = x @ x[ids == qid][0]
        s[ids == qid] = -9
        hit += len(set(ids[np.argsort(-s)[:5]]) & set(got[got.query_id == qid].vec_id))
    assert hit >= 0.9 * len(got)


def test_bit_slices_add_up():
    rng = np.random.default_rng(0)
    v = rng.integers(-500, 500, (70, 5))
    block = bitslice.SlicedBlock(np.arange(70) * 3, v)
    for _ in range(20):
        q = rng.integers(-300, 300, 5)
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:70].astype(np.int64) << i for i, s in enumerate(block.add(q))]
        sums = np.sum(bits, axis=0) if bits else np.zeros(70, np.int64)
        assert np.array_equal(sums - sums[0], v @ q - v[0] @ q)
        ids, scores = block.top(q, 30, 10)
        want = sorted(((-int(v[i] @ q), i * 3) for i in range(70) if i != 10))[:10]
        assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_exact_top_k(spark):
    rows = vectors(d=6, seed=2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0))
    got = bitslice.top_inner_products(bitslice.quantised(df), F.col("id") % 10 == 0, k=10, block=64, query_block=8)
    x = {i: np.floor(1024 * v).astype(np.int64) for i, v in fine(rows).items()}
    want = [(a, n + 1, b, s) for a in x if a % 10 == 0 for n, (s, b) in enumerate([(-s, b) for s, b in sorted((-int(x[a] @ x[b]), b) for b in x if b != a)[:10]])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert bitslice.top_inner_products(bitslice.quantised(df.filter("false")), F.lit(True)).count() == 0


def test_exact_top_k_of_large_components(spark):
    rows = [(10, [20000.0, 1.0]), (11, [-3e5, 0.5]), (12, [1e6, -2e6]), (20, [0.0, 1e-320]), (21, [4e12, 1.0]), (22, [-0.25, -1e-9]), (30, [1e300, -1e300]), (31, [float("inf"), 1.0]), (32, [1e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: [math.floor(Fraction(c) * 1024) for c in v] for i, v in rows if all(map(math.isfinite, v))}
    short = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for a in (i for i in x if i % 10 == 0):
        scores = sorted((-short(sum(p * q for p, q in zip(x[a], x[b], strict=True))), b) for b in x if b != a)
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(scores)]
    got = bitslice.top_inner_products(bitslice.quantised(df), F.col("id") % 10 == 0, k=10)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tokens_by_parts_are_the_tokenizers():
    t = packing.Tokens(**{"path": packing.default_tokenizer()["tokenizer"], "ranks": packing.default_tokenizer()["ranks"]})
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "Bc", ".", "'s", "12", "é", " ", " ", "\x1c", "\x85", "​", "中", "<|endoftext|>", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert t.encode(text) == t.ids(text), repr(text)


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 3, 40, 300, 900]))) for _ in range(150)] + [None, "", "x " * 6000]
    docs = spark.createDataFrame([(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").withColumn("length", F.lit(1))
    got = packing.pack(packing.pieces(docs, **packing.default_tokenizer()), node_items=40, fan_in=2).collect()
    t = packing.Tokens(packing.default_tokenizer()["tokenizer"])
    want = []
    for i, text in [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]:
        raw = (t.ids(text) if text else b"") + (2).to_bytes(4, "little")
        n = len(raw) // 4
        starts = [0, *range(n % 1024 or 1024, n, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    # no worse than best-fit over everything at once, but for a little
    assert len(bins) <= 1.03 * len(packing.best_fit([r.length for r in got], 1024)) + 1
    assert packing.pack(packing.pieces(docs.filter("false"), **packing.default_tokenizer())).count() == 0


def test_best_fit():
    sizes = [600, 500, 424, 524, 100, 1024, 1]
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(7)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins) and len(bins) == 4


def test_merkle_audit(spark):
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", "é<p>" * rng.randint(0, 50)) for i in range(700)] + [(None, None, None), (5, "http://h/", "again")], "page_id long, url string, html string").withColumn("file", F.lit(7))
    m = warc.manifest(pages, file_bytes=20_000).select("file", "n", "begin", "end", "hash").cache()
    assert warc.audit(m, m).count() == 0
    some = [tuple(r) for r in m.orderBy("file", "n").select("file", "n").collect()]
    bad, lost = set(some[10:13]), {some[40], some[-1]}
    hit = lambda s: F.struct("file", "n").isin([F.struct(F.lit(a), F.lit(b)) for a, b in s]) if False else F.concat_ws("/", "file", "n").isin([f"{a}/{b}" for a, b in s])
    other = m.withColumn("hash", F.when(hit(bad), F.lit("00")).otherwise(F.col("hash"))).filter(~hit(lost))
    got = {(r.file, r.n, r.finding) for r in warc.audit(m, other).collect()}
    assert got == {(*x, "changed") for x in bad} | {(*x, "missing") for x in lost}
    assert {r.finding for r in warc.audit(other, m).collect()} == {"changed", "extra"}
    assert warc.audit(m.filter("false"), m.filter("false")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é\r\n\r\n" * (i % 7)) for i in range(60)] + [(None, None, None)], "page_id long, url string, html string")
    recs = warc.records(pages, file_bytes=2000)
    warc.write_warc(recs, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    both = recs.join(back, ["file", "begin", "end"])
    assert both.count() == recs.count() == back.count() == 61
    assert both.filter("record <> concat(header, '\r\n\r\n', cast(body as string))").count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    want = c.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "suffix_dedup", "packing"]
    got = corpus_pipeline.run(spark, D)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = got.select("doc_id").distinct()
    assert kept.join(docs, "doc_id", "left_anti").count() == 0 and 0.7 * docs.count() < kept.count() < docs.count()
    # of exact copies one stays
    assert docs.join(kept, "doc_id", "left_semi").groupBy("text").count().filter("count > 1").count() == 0


@needs_data
def test_stages_keep_odd_documents(spark):
    from worklens.llm import langid, simhash, toxicity

    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "The and that", "en", "s", 3), (4, "The and of the that " * 300, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert toxicity.toxicity_stage(spark, docs, D).count() == 5
    assert sorted(str(r.doc_id) for r in langid.language_stage(spark, docs, D).collect()) == ["4", "None"]
    kept = simhash.simhash_stage(spark, docs, D)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
