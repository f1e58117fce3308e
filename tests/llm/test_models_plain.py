"""op2 and op8 against plain loops; empty tables and clashing columns of op1, op2, op8, op9."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import ann, langid, pieces, toxicity


def plain_scores(net, text):
    """The same network, a window and a place at a time: each input is a word's embedding beside the scaled sum of its n-grams' embeddings."""
    p, h_size = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.H
    words = re.findall(r"[^\W_]+", text.lower())
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def inputs(word):
        own = p["words"][net.vocab.get(word, len(net.vocab))]
        marked, total, n = f"<{word}>", np.zeros(toxicity.D), 0
        for size in toxicity.GRAMS:
            for a in range(len(marked) - size + 1):
                h = size
                for c in marked[a : a + size]:
                    h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                    h ^= h >> 15
                total, n = total + p["grams"][h % toxicity.SLOTS], n + 1
        return np.concatenate([own, total / math.sqrt(max(n, 1))])

    x = [inputs(w) @ p["wx"] + p["bx"] for w in words]
    best = None
    step = toxicity.STRIDE
    starts, a = [0], step
    while words and starts[-1] + toxicity.WIDTH < len(words):
        starts.append(a)
        a += step
    for start in starts if words else []:
        window, states = x[start : start + toxicity.WIDTH], []
        for direction in (0, 1):
            h, line = np.zeros(h_size), []
            for row in window if direction == 0 else window[::-1]:
                g = row.reshape(2, 3 * h_size)[direction]
                hu = h @ p["u"][direction]
                z, r = sigmoid(g[:h_size] + hu[:h_size]), sigmoid(g[h_size : 2 * h_size] + hu[h_size : 2 * h_size])
                c = np.tanh(g[2 * h_size :] + r * hu[2 * h_size :])
                h = z * h + (1 - z) * c
                line.append(h)
            states.append(line if direction == 0 else line[::-1])
        both = [np.concatenate(s) for s in zip(*states, strict=True)]
        e = np.array([b @ p["a"] for b in both])
        alpha = np.exp(e - e.max())
        pooled = sum(w * b for w, b in zip(alpha / alpha.sum(), both, strict=True))
        score = sigmoid(pooled @ p["w"] + p["b"][0])
        best = score if best is None else max(best, score)
    return 0.0 if best is None else float(best)


def test_toxicity_against_plain_loops(spark):
    rng = random.Random(1)
    vocabulary = ["fine", "words", "number", "more", "scum", "vile", "naïve", "x1", "日本語", "unseen"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(n))
    net = toxicity.fit([text(30) + (" scum vile" if i % 2 else "") for i in range(80)], [i % 2 for i in range(80)], steps=40)
    texts = [text(n) for n in (1, 2, 39, 40, 41, 69, 70, 71, 100, 101, 400)] + [None, "", "_ !", "other words entirely " * 20]
    got = {r.i: r.toxicity for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("score", F.lit("x")), net).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_scores(net, t or ""), abs=2e-5), (i, t and len(t.split()))


def plain_language(model, text):
    """Known words by their own row; others place by place with the longest known n-gram; the mean of these rows is the word's."""
    words, row = re.findall(r"[^\W\d_]+", (text or "").lower()), {}
    sums = np.zeros(len(model["langs"]))
    for w in words:
        if (True, w) in model["index"]:
            sums += model["table"][model["index"][(True, w)]]
            continue
        marked, rows = f"<{w}>", []
        for a in range(len(marked)):
            for size in range(model["max_n"], 0, -1):
                if a + size <= len(marked) and (False, marked[a : a + size]) in model["index"]:
                    rows.append(model["table"][model["index"][(False, marked[a : a + size])]].astype(np.float64))
                    break
        sums += np.mean(rows, axis=0) if rows else 0
    if not words:
        return "und", 0.0
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    return model["langs"][best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def test_language_against_plain_loops(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["sch", "und", "lich", "keit"], "fr": ["eau", "oux", "ette", "que"]}
    word = lambda g: "".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word(g) for _ in range(25)), g) for i in range(40) for g in parts]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = [" ".join(word(rng.choice(list(parts))) for _ in range(rng.randint(1, 40))) for _ in range(60)] + [None, "", "1 2", "zzz", "Ⅷ the", "QUE9und_the"]
    got = {r.i: (r.lang_pred, r.lang_score) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("lang", F.lit("x")), model).collect()}
    for i, t in enumerate(texts):
        want = plain_language(model, "the" if t == "Ⅷ the" else t)
        assert got[i] == (want[0], pytest.approx(want[1], abs=1e-4)), t


def test_training_counts_words_and_grams(spark):
    model = langid.train(spark.createDataFrame([(i, t, g) for i in range(3) for t, g in (("abc abd", "x"), ("abc", "y"))], "doc_id long, text string, lang string"))
    rows = lambda *w: model["table"][model["index"][w]].astype(np.float64)
    # words known: abc (3 and 3), abd (3 and 0)
    assert np.allclose(rows(True, "abc"), [math.log(3.1 / (1 + 6 + 0.2)), math.log(3.1 / (1 + 3 + 0.2))], atol=1e-5)
    assert np.allclose(rows(True, "abd"), [math.log(3.1 / 7.2), math.log(0.1 / 4.2)], atol=1e-5)
    assert (False, "<ab") in model["index"] and (False, "abd>") in model["index"] and (False, "zz") not in model["index"]


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(none)
    assert langid.predict(none, model).count() == 0 and toxicity.score(none, None).count() == 0
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    clash = vectors.withColumns({"id": F.lit(0), "score": F.lit("s"), "rank": F.lit(1), "v": F.lit(None).cast("string"), "query_id": F.lit(2)})
    plain, odd = (sorted(map(tuple, ann.nearest(x, F.col("vec_id") % 10 == 0, k=3).select("query_id", "rank", "vec_id").collect())) for x in (vectors, clash))
    assert plain == odd and len(plain) == 12
    texts = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    model = pieces.default_model()
    odd = texts.withColumns({"score": F.lit(1), "ids": F.lit("p"), "sample": F.lit(2), "key": F.lit(3)})
    same = [sorted(map(str, pieces.sampled(x, model).collect())) for x in (texts, odd)]
    assert same[0] == same[1] and len(same[0]) >= 2 and pieces.sampled(texts.filter("false"), model).count() == 0
