"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own embedding (common words) beside the sum of the embeddings of its character n-grams (hashed;
any word). Two recurrent passes read a window of `WIDTH` words, attention pools their states, and a logistic
unit scores the window. Windows overlap: one starts at every `STRIDE` words. A text scores the maximum over all its windows, and
training follows that: the gradient goes through the window that scores highest.

Training takes a bounded sample of labelled texts: about `n_toxic` and `n_clean` by hash of the id, none over `max_chars`
characters. Embeddings begin at how
far counts in the sample's toxic texts stand from chance. Labels, lang, source and ids are never inputs.

Cases: a null or empty text, or one without a word, scores 0; without a label of each kind every text
scores 0. A label that is null doesn't count; of repeated labels for one id the largest holds. Rows with a null id are scored.
Texts are scored whole, however long. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import remainder, resident, slices, vacate

WORD = re.compile(r"[^\W_]+")
WIDTH, STRIDE = 40, 30
D, H = 8, 8  # size of each embedding, of each direction's state
GRAMS, SLOTS = (3, 4, 5), 1 << 17
MEMO = 120_000
BATCH = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all character n-grams of "<word>", and for each the number of its word."""
    text = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    slots, of = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ code[j : j + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ok = owner[:m] == owner[n - 1 :]
        slots.append((h[ok] % np.uint32(SLOTS)).astype(np.int32))
        of.append(owner[:m][ok])
    slot, word = np.concatenate(slots), np.concatenate(of)
    order = np.argsort(word, kind="stable")
    return slot[order], word[order]


def windows(n: int) -> list[int]:
    """Where the windows of a text of n words begin; the last one reaches its end."""
    return list(range(0, max(1, n - (WIDTH - STRIDE)), STRIDE)) if n else []


class Network:
    def __init__(self, vocab: dict[str, int], rng: np.random.Generator):
        self.vocab = vocab
        small = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {
            "words": small(len(vocab) + 1, D) * (np.arange(len(vocab) + 1) < len(vocab))[:, None],  # the last row: any other word
            "grams": small(SLOTS, D) * 0.3,
            "wx": small(2 * D, 6 * H) * 2,
            "bx": np.tile(np.repeat(np.array([0.5, 0, 0], np.float32), H), 2),
            "u": small(2, H, 3 * H) * 2,
            "a": small(2 * H) * 2,
            "w": small(2 * H) * 4,
            "b": np.array([-1.0], np.float32),
        }

    def named(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array([self.vocab.get(w, len(self.vocab)) for w in words], np.int64)
        return own, *gram_slots(words)

    def inputs(self, words: list[str]) -> np.ndarray:
        return self.embed(*self.named(words))

    def embed(self, own, slot, word) -> np.ndarray:
        n = np.bincount(word, minlength=len(own)).clip(1)
        scale = (1 / np.sqrt(n)).astype(np.float32)
        begin = np.searchsorted(word, np.arange(len(own)))
        total = np.add.reduceat(np.concatenate([self.p["grams"][slot], np.zeros((1, D), np.float32)]), begin, axis=0) * scale[:, None]
        return np.concatenate([self.p["words"][own], total], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["wx"] + self.p["bx"]

    def run(self, rows: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows: rows (windows, WIDTH, 6H) are projected inputs, real marks places that hold a word."""
        n, t = real.shape
        g = rows.reshape(n, t, 2, 3, H)
        g = np.stack([g[:, :, 0], g[:, ::-1, 1]]).reshape(2, n, t, 3 * H)
        on = np.stack([real, real[:, ::-1]])
        h, states, kept = np.zeros((2, n, H), np.float32), np.empty((2, n, t, H), np.float32), []
        full = bool(real.all())
        for k in range(t):
            hu = h @ self.p["u"]
            zr = _sigmoid(g[:, :, k, : 2 * H] + hu[:, :, : 2 * H])
            z, r = zr[:, :, :H], zr[:, :, H:]
            c = np.tanh(g[:, :, k, 2 * H :] + r * hu[:, :, 2 * H :])
            if not full:  # at a place without a word the state stays
                z = np.where(on[:, :, k, None], z, np.float32(1))
            if keep:
                kept.append((h, z, r, c, hu[:, :, 2 * H :]))
            h = c + z * (h - c)
            states[:, :, k] = h
        both = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        e = np.where(real, both @ self.p["a"], np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=1, keepdims=True))
        alpha /= alpha.sum(axis=1, keepdims=True)
        pooled = np.matmul(alpha[:, None, :], both)[:, 0]
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, (both, alpha, pooled, kept, on)) if keep else logit

    def back(self, d: np.ndarray, state) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters after the projection, and of the projected inputs, from d = dloss/dlogit."""
        both, alpha, pooled, kept, on = state
        n, t, _ = both.shape
        grad = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["w"]
        da = np.matmul(both, dp[:, :, None])[:, :, 0]
        de = alpha * (da - (alpha * da).sum(axis=1, keepdims=True))
        grad["a"] = np.einsum("nt,ntk->k", de, both)
        dboth = alpha[:, :, None] * dp[:, None, :] + de[:, :, None] * self.p["a"]
        ds = np.stack([dboth[:, :, :H], dboth[:, ::-1, H:]])
        dh, du, dg = np.zeros((2, n, H), np.float32), np.zeros_like(self.p["u"]), np.zeros((2, n, t, 3 * H), np.float32)
        for k in range(t - 1, -1, -1):
            h, z, r, c, huc = kept[k]
            dh = dh + ds[:, :, k]
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * huc * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], axis=2)
            dg[:, :, k] = np.concatenate([dz, dr, dc], axis=2) * on[:, :, k, None]
            du += np.matmul(h.transpose(0, 2, 1), dhu)
            dh = dh * z + np.matmul(dhu, self.p["u"].transpose(0, 2, 1))
        grad["u"] = du
        return grad, np.stack([dg[0], dg[1][:, ::-1]], axis=2).reshape(n, t, 6 * H)


def _layout(n_words: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Window of place: text number of each window, and the words' places in all texts joined (-1: none)."""
    text, place, base = [], [], 0
    for i, n in enumerate(n_words):
        starts = np.array(windows(n), np.int64)
        at = starts[:, None] + np.arange(WIDTH)
        place.append(np.where(at < n, at + base, -1))
        text.append(np.full(len(starts), i))
        base += n
    if not text:
        return np.zeros(0, np.int64), np.zeros((0, WIDTH), np.int64)
    return np.concatenate(text), np.concatenate(place)


def fit(texts: list[str], labels: list[int], *, epochs=6, steps=240, batch=64, rate=0.01, n_vocab=4000, seed=7) -> Network:
    """Train on texts in memory (a bounded sample): `epochs` passes over them, or more until there were `steps` batches."""
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # equal words are one string
    words = [[one.setdefault(w, w) for w in WORD.findall(t.lower())] for t in texts]
    known = [i for i, w in enumerate(words) if w]
    words, y = [words[i] for i in known], np.array([labels[i] for i in known], np.float32)
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float(len(y) - y.sum()))
    seen = [Counter(), Counter()]
    for w, label in zip(words, y, strict=True):
        seen[int(label)].update(set(w))
    total = seen[0] + seen[1]
    names = sorted(total, key=lambda w: (-total[w], w))
    vocab = {w: i for i, w in enumerate([w for w in names if total[w] >= 3][:n_vocab])}
    net = Network(vocab, rng)
    distinct = names
    at = {w: i for i, w in enumerate(distinct)}
    own, slot, word = net.named(distinct)  # no embeddings of all words: batches embed their own
    # begin at how far a word's or n-gram's count in toxic texts stands from chance, in standard deviations; what
    # fewer than 3 texts hold stays at zero
    def odd(a, b):
        hope = n1 * (a + b) / (n1 + n0)
        return np.clip((a - hope) / np.sqrt(hope * n0 / (n1 + n0) + 1), -3, 8) / 4

    net.p["words"][: len(vocab), 0] = [odd(seen[1][w], seen[0][w]) for w in vocab]
    begin = np.searchsorted(word, np.arange(len(distinct) + 1))
    counts = np.zeros((2, SLOTS), np.int32)
    for w, label in zip(words, y, strict=True):
        got = np.unique(np.concatenate([slot[begin[i] : begin[i + 1]] for i in {at[v] for v in w}]))
        counts[int(label), got] += 1
    net.p["grams"][:, 0] = odd(counts[1], counts[0])
    live = counts.sum(axis=0) >= 3
    net.p["grams"] *= live[:, None]
    ids = [np.array([at[v] for v in w], np.int64) for w in words]
    del words, one
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(epochs, -(-steps // max(1, len(ids) // batch)))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
            text, place = _layout([len(ids[i]) for i in part])
            flat = np.concatenate([ids[i] for i in part])
            uniq, back = np.unique(flat, return_inverse=True)
            lo, n = begin[uniq], begin[uniq + 1] - begin[uniq]
            pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            u_slot, u_word, u_own = slot[pick], np.repeat(np.arange(len(uniq)), n), own[uniq]
            x = net.embed(u_own, u_slot, u_word)
            rows = np.concatenate([net.project(x), np.zeros((1, 6 * H), np.float32)])
            which = np.where(place >= 0, back[place], len(uniq))
            logit = np.concatenate([net.run(rows[which[a : a + BATCH]], place[a : a + BATCH] >= 0) for a in range(0, len(which), BATCH)])
            order = np.lexsort((-logit, text))
            best = order[np.searchsorted(text[order], np.arange(len(part)))]
            out, state = net.run(rows[which[best]], place[best] >= 0, keep=True)
            d = ((_sigmoid(out) - y[part]) / len(part)).astype(np.float32)
            grad, dg = net.back(d, state)
            flat_w, flat_d = which[best].ravel(), dg.reshape(-1, 6 * H)
            real = flat_w < len(uniq)
            flat_w, flat_d = flat_w[real], flat_d[real]
            grad["wx"], grad["bx"] = x[flat_w].T @ flat_d, flat_d.sum(axis=0)
            dx = np.zeros_like(x)
            np.add.at(dx, flat_w, flat_d @ net.p["wx"].T)
            hit = np.flatnonzero(np.abs(dx).sum(axis=1))
            grad["words"] = np.zeros_like(net.p["words"])
            np.add.at(grad["words"], u_own[hit], dx[hit, :D])
            grad["words"][-1] = 0
            scale = 1 / np.sqrt(np.bincount(u_word, minlength=len(uniq)).clip(1))
            touched = np.isin(u_word, hit) & live[u_slot]
            some, to = np.unique(u_slot[touched], return_inverse=True)
            grad["grams"] = np.zeros((len(some), D), np.float32)
            np.add.at(grad["grams"], to, (dx[:, D:] * scale[:, None]).astype(np.float32)[u_word[touched]])
            step += 1
            now = rate * (1 - epoch / (epochs + 1))
            for k, g in grad.items():
                at_rows = some if k == "grams" else slice(None)
                m, v = (x[at_rows] for x in moment[k])
                m = m + 0.1 * (g - m)
                v = v + 0.01 * (g * g - v)
                moment[k][0][at_rows], moment[k][1][at_rows] = m, v
                net.p[k][at_rows] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class _Scorer:
    """Scores texts; projected inputs of words are kept while there is room."""

    def __init__(self, net: Network):
        self.net, self.at = net, {}
        self.rows = np.zeros((MEMO + 1, 6 * H), np.float32)  # row 0: no word

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        out = np.zeros(len(texts))
        if not flat:
            return out
        new = sorted(set(flat).difference(self.at))
        room = MEMO - len(self.at)
        x = self.net.project(self.net.inputs(new)) if new else np.zeros((0, 6 * H), np.float32)
        base = len(self.at) + 1
        self.rows[base : base + min(room, len(new))] = x[:room]
        self.at.update(zip(new[:room], range(base, base + room), strict=False))
        rows, at = self.rows, self.at
        if len(new) > room:  # the rest for these texts alone
            rows = np.concatenate([self.rows, x[room:]])
            at = _Two(self.at, dict(zip(new[room:], range(len(self.rows), len(rows)), strict=True)))
        ids = np.append(np.fromiter(map(at.__getitem__, flat), np.int64, len(flat)), 0)
        text, place = _layout([len(w) for w in words])
        logit = np.concatenate([self.net.run(rows[ids[place[a : a + BATCH]]], place[a : a + BATCH] >= 0) for a in range(0, len(place), BATCH)])
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] = _sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))
        return out


class _Two(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", n_toxic=1200, n_clean=2000, max_chars=10_000) -> Network | None:
    """Network fitted on a bounded sample of `labels` (id, label) joined to `docs`."""
    known = labels.filter(f"{label_col} in (0, 1) and {id_col} is not null").groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("y") == 1, n_toxic / n[1]).otherwise(n_clean / n[0])
    sample = known.filter(F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("toxic")), F.lit(1_000_003)) / 1_000_003 < share).orderBy("y", "i").limit(2 * (n_toxic + n_clean))
    texts = docs.filter(F.length(text_col) <= max_chars).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    got = texts.join(F.broadcast(sample), "i").orderBy("i", "t").limit(2 * (n_toxic + n_clean)).collect()
    net = fit([r.t for r in got], [r.y for r in got]) if len({r.y for r in got}) == 2 else None
    del got
    vacate()
    return net


def score(docs: DataFrame, net: Network | None, *, text_col="text", out="toxicity") -> DataFrame:
    """`docs` with a column more: the largest score (0 to 1) of any window of the whole text."""
    sent, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(key, lambda: _Scorer(sent.value)) if sent.value is not None else None
        for batch in slices(batches, text_col, 2 << 20):
            found = scorer.scores(batch.column(text_col).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = remainder("doc_id", 3) == 1
    net = train(docs, labels.filter(~held))
    found = score(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Pipeline stage: documents that score `threshold` or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = train(docs, labels.filter(remainder("doc_id", 3) != 1))
    return score(docs, net, out="_wl_toxicity").filter(F.col("_wl_toxicity") < threshold).select(*docs.columns)
