"""op2, op8: held-out accuracy and odd inputs; op9: exact distributions and round trips."""

import collections
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import langid, pieces, toxicity

D = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
ODD = [(1, None), (2, ""), (3, "123 !!"), (4, "plain words here"), (4, "plain words here"), (None, "words"), (5, "word " * 30_000)]


@needs_data
def test_language(spark):
    got = langid.op8_language_id(spark, D)
    truth = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count() and got.filter("score < 0 or score > 1").count() == 0


def test_language_letters(spark):
    docs = spark.createDataFrame([(i, t, g) for i in range(40) for t, g in (("wolno czytam " + "z" * 60, "pl"), ("read slowly here", "en"))], "doc_id long, text string, lang string")
    texts = ["² ½", "Ⅷ", "12 _", "read²slowly", "z" * 60, "y" * 10 + "z" * 45]
    got = langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), langid.train(docs)).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "pl", "pl"]
    docs = docs.unionByName(spark.createDataFrame([(i, "qqq www", "und") for i in range(40)], docs.schema))
    assert langid.predict(spark.createDataFrame([("qqq www",)], "text string"), langid.train(docs)).first().lang_pred == "und"


def test_language_odd(spark):
    docs = spark.createDataFrame([(10, "the cat sat", "en"), (11, "le chat assis", "fr"), (12, None, "de"), (13, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model["langs"] == ["en", "fr"]
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = [r.lang_pred for r in langid.predict(odd, model).collect()]
    assert got[:3] == ["und"] * 3 and all(g in ("en", "fr") for g in got[3:])
    nothing = langid.train(docs.filter("false"))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_unseen_words_back_off(spark):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("schlichung verschlich schlich", "de"), ("eauteur beaueau neaux", "fr")] * 4)], "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame([("schlicheit",), ("teaueaux",)], "text string"), langid.train(docs)).collect()
    assert [r.lang_pred for r in got] == ["de", "fr"]


@needs_data
def test_toxicity(spark):
    got = toxicity.op2_toxicity(spark, D)
    labels = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic")
    held = got.join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    order = np.mean([(toxic.score.values > c).mean() + 0.5 * (toxic.score.values == c).mean() for c in clean.score.values])
    assert order > 0.8 and clean.predicted.mean() < 0.05
    assert got.filter("score < 0 or score > 1 or (score >= 0.7) <> (predicted = 1)").count() == 0


def test_toxicity_odd(spark):
    texts = [f"fine words number {i} and more" for i in range(60)] + [f"you scum number {i} and more" for i in range(60)]
    net = toxicity.fit(texts, [0] * 60 + [1] * 60, steps=60)
    s = toxicity._Scorer(net).scores(["fine words and more", "you scum and more", None, "", "?!", "fine words and more " * 2000 + "you scum and more " * 15])
    assert s[0] < 0.5 < s[1] and s[5] > 0.5 and not s[2:5].any()
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    assert toxicity.score(odd, net).count() == len(ODD)
    assert {r.toxicity for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network({"a": 0, "b": 1}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = rng.standard_normal((3, toxicity.WIDTH, 6 * toxicity.H))
    real = np.ones((3, toxicity.WIDTH), bool)
    real[1, 7:] = False
    d = np.array([0.3, -0.2, 0.5])
    logit, state = net.run(rows, real, keep=True)
    state = tuple(x for x in state)
    grad, drows = net.back(d, state)
    for name, at in (("w", 3), ("a", 5), ("u", (1, 2, 10)), ("b", 0)):
        kept, eps = net.p[name][at], 1e-3
        net.p[name][at] = kept + eps
        up = net.run(rows, real) @ d
        net.p[name][at] = kept - eps
        down = net.run(rows, real) @ d
        net.p[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-3)
    at, eps = (1, 3, 20), 1e-2
    more, less = rows.copy(), rows.copy()
    more[at] += eps
    less[at] -= eps
    assert drows[at] == pytest.approx((net.run(more, real) - net.run(less, real)) @ d / (2 * eps), rel=0.05, abs=2e-3)


def test_windows_cover_texts():
    for n in range(0, 300):
        starts = toxicity.windows(n)
        seen = {p for s in starts for p in range(s, min(n, s + toxicity.WIDTH))}
        assert seen == set(range(n))


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattices(pieces.default_model())


def cuts(lat, unit):
    if not unit:
        return {(): 1.0}
    out = {}
    for j in range(1, len(unit) + 1):
        p = unit[:j]
        w = math.exp(lat.weight[p]) if p in lat.ids else None
        ids = (lat.ids[p],) if w else ()
        if w is None and j == 1:
            ids, w = tuple(lat.byte[b] for b in p.encode()), (10 + len(lat.ids)) ** -float(len(p.encode()))
        if w:
            for rest, v in cuts(lat, unit[j:]).items():
                out[ids + rest] = out.get(ids + rest, 0) + w * v
    return out


def test_sampling_distribution(lattice):
    text = "cat\nin"
    every = {}
    for combo in itertools.product(*[cuts(lattice, u).items() for u in lattice.units(text)]):
        ids = tuple(i for c in combo for i in c[0])
        every[ids] = every.get(ids, 0) + math.prod(c[1] for c in combo)
    total = sum(every.values())
    every = {k: v / total for k, v in every.items()}
    n = 12_000
    got = pieces.sample_texts(lattice, list(range(n)), [text] * n, 3, 11)
    first, second = (collections.Counter(tuple(g[j][0]) for g in got) for j in (0, 1))
    for ids, p in sorted(every.items(), key=lambda x: -x[1])[:4]:
        then = sum(q * p / (1 - q) for other, q in every.items() if other != ids)
        assert first[ids] / n == pytest.approx(p, abs=0.015) and second[ids] / n == pytest.approx(then, abs=0.015)
    assert all(len({tuple(x[0]) for x in g}) == 3 and g[0][2] >= g[1][2] >= g[2][2] for g in got)
    assert all(x[1] == pytest.approx(math.log(every[tuple(x[0])])) for g in got[:200] for x in g)
    # inclusion scores estimate sums over all segmentations without bias
    assert np.mean([sum(math.exp(x[1]) / x[3] for x in g) for g in got]) == pytest.approx(1, abs=0.02)


def test_sampling_round_trip(spark, lattice):
    texts = ["Hello  world\n x", " é中\t🙂 ", "", None, "▁odd▁ text", "a" * 3000, "word " * 5000, "same", "same"]
    docs = spark.createDataFrame([(i if i != 6 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(0))
    rows = pieces.decoded(pieces.sampled(docs, pieces.default_model(), k=3), pieces.default_model()).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.id].append(r)
    for i, t in enumerate(texts):
        mine = by[i if i != 6 else None]
        assert all(r.text == (t or "").replace("▁", " ") for r in mine) and len({tuple(r.ids) for r in mine}) == len(mine)
    assert len(by[2]) == len(by[3]) == 1 and by[2][0].inclusion == 1


def test_sampling_does_not_depend_on_batches(lattice):
    texts = [f"some words here {i}" for i in range(20)]
    whole = pieces.sample_texts(lattice, list(range(20)), texts, 2, 5)
    single = [pieces.sample_texts(lattice, [i], [t], 2, 5)[0] for i, t in enumerate(texts)]
    assert [[x[0].tolist() for x in g] for g in whole] == [[x[0].tolist() for x in g] for g in single]


def test_training_embeds_a_batch_at_a_time(monkeypatch):
    """No table of all the sample's words, and grams are counted in small numbers: the driver's memory is bounded by a batch."""
    from worklens.llm import toxicity

    seen, plain = [], toxicity.Network.embed
    monkeypatch.setattr(toxicity.Network, "embed", lambda self, own, slot, word: (seen.append(len(own)), plain(self, own, slot, word))[1])
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(16)]
    toxicity.fit(texts, [i % 2 for i in range(16)], epochs=1, steps=1, batch=2)
    assert seen and max(seen) <= 2 * 20
    assert all(a.dtype == np.int32 for a in toxicity.gram_slots(["one", "two"]))
