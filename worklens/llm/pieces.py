"""SentencePiece segmentations sampled without replacement: Gumbel top-k by best-first search over the perturbed lattice.

A text is normalised as the model does, and its lattice holds every way to cut it into the model's pieces (characters the
model lacks become byte pieces). A segmentation's weight is the product of its pieces' weights, 1 / (10 + rank): the model is of the BPE kind and
has ranks, not probabilities. The lattice is a chain of units (a run of spaces and the visible text
after it, or a line feed), since no piece crosses from one into the next.

The search draws a Gumbel value for the root, the whole lattice. Following a node's best child keeps the node's value; the other children get
theirs conditioned on it not being exceeded. The best open child of all goes next, so leaves come out in the order of their perturbed
log probability: the first `k` are a sample without replacement. A segmentation's inclusion score is the probability that its value passes the
best value left out. All random numbers are hashes of the row's key and the place in its lattice, so they don't
depend on batches or machines.

Cases: a null or empty text has the one empty segmentation; texts with fewer than `k` segmentations give all, with
score 1. Repeated rows, equal in key and text, get equal samples; a null key counts as 0. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import mix
from .common import resident, slices

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
FINE_UNIT = re.compile(f"{SPACE}+(?:[^\\W\\d_]+(?=[.,])|[^{SPACE}\n]*)|\n|[^{SPACE}\n]+")
KEPT_NODES = 1_500_000
SAMPLES = "id long, sample int, ids array<int>, log_prob double, gumbel double, inclusion double"


class Lattices:
    """The model's pieces, and the lattices of units met so far as flat arrays of nodes and their children."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        usable = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.ids = {self.model.id_to_piece(i): i for i in usable}
        self.longest = max(map(len, self.ids))
        self.weight = {p: -math.log(10 + i) for p, i in self.ids.items()}
        self.byte = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        # by length: hashes of all beginnings of pieces, their ids (0: a beginning only) and weights
        self.table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in range(1, self.longest + 1):
            heads = sorted({p[:m] for p in self.ids if len(p) >= m})
            code = np.frombuffer("".join(heads).encode("utf-32-le"), np.uint32).reshape(-1, m)
            h = np.zeros(len(heads), np.uint64)
            for j in range(m):
                h = mix(h ^ (code[:, j].astype(np.uint64) + np.uint64((j + 1) << 32)))
            order = np.argsort(h)
            ids = np.array([self.ids.get(p, 0) for p in heads], np.int64)[order]
            self.table[m] = (h[order], ids, -np.log(10.0 + ids))
        # a letter and a stop or comma after it can be parted if no piece holds such a pair
        joined = any(re.search(r"[^\W\d_][.,]", p) for p in self.ids)
        self.cut = UNIT if joined else FINE_UNIT
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.passing: list[str] = []
        self.kept: tuple | None = None
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)  # a node's children
        self.next, self.piece, self.logp = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)  # a child's node, -1: the end

    def add(self, units: set[str]) -> None:
        """Lattices of new units: a node for each character, a child for each piece that begins there. A piece that is a character's bytes
        is kept as minus its code point."""
        if not units:
            return
        names = list(units)
        code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        size = np.array([len(u) for u in names], np.int64)
        end = np.repeat(np.cumsum(size), size)
        at, found = np.arange(len(code)), []
        h = np.zeros(len(code), np.uint64)
        single = np.zeros(len(code), bool)
        for n in range(1, self.longest + 1):
            ok = at + n <= end[at]
            at = at[ok]
            if not len(at):
                break
            h = mix(h[ok] ^ (code[at + n - 1].astype(np.uint64) + np.uint64(n << 32)))
            keys, ids, weight = self.table[n]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            go = np.flatnonzero(keys[i] == h)  # the others begin no piece of this length or more
            at, h, i = at[go], h[go], i[go]
            hit = ids[i] > 0
            found.append((at[hit], np.full(int(hit.sum()), n), ids[i[hit]], weight[i[hit]]))
            if n == 1:
                single[at[hit]] = True
        bare = np.flatnonzero(~single)
        n_bytes = 1 + (code[bare] >= 0x80).astype(np.int64) + (code[bare] >= 0x800) + (code[bare] >= 0x10000)
        found.append((bare, np.ones(len(bare), np.int64), -code[bare].astype(np.int64), -math.log(10 + len(self.ids)) * n_bytes))
        start, length, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((length, start))
        start, length, piece, weight = start[order], length[order], piece[order], weight[order]
        count = np.bincount(start, minlength=len(code))
        first = np.cumsum(count) - count
        to = start + length
        # log sums of all ways to the unit's end, from the last character backward in all units at once
        beta, left = np.zeros(len(code) + 1), end - np.arange(len(code))
        by_left = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
        last = to == end[start]
        for a, b in zip(cuts, cuts[1:], strict=False):
            node = by_left[a:b]
            n = count[node]
            begin = np.cumsum(n) - n
            edge = np.repeat(first[node] - begin, n) + np.arange(n.sum())
            s = weight[edge] + np.where(last[edge], 0.0, beta[to[edge]])
            top = np.maximum.reduceat(s, begin)
            beta[node] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, n)), begin))
        logp = weight + np.where(last, 0.0, beta[to]) - beta[start]
        base = len(self.first)
        if base > KEPT_NODES:
            self.passing = names
        self.root.update(zip(names, (np.cumsum(size) - size + base).tolist(), strict=True))
        self.first = np.append(self.first, (first + len(self.next)).astype(np.int32))
        self.count = np.append(self.count, count.astype(np.int32))
        self.next = np.append(self.next, np.where(last, -1, to + base).astype(np.int32))
        self.piece, self.logp = np.append(self.piece, piece.astype(np.int32)), np.append(self.logp, logp)

    def release(self) -> None:
        """Forget the units added after the first KEPT_NODES nodes: they were needed for one batch."""
        if self.passing:
            for u in self.passing:
                del self.root[u]
            self.passing = []
            self.first, self.count, self.next, self.piece, self.logp = self.kept
        elif len(self.first) > KEPT_NODES and self.kept is None:
            self.kept = (self.first, self.count, self.next, self.piece, self.logp)

    def units(self, text: str | None) -> list[str]:
        return self.cut.findall(self.model.normalize(text)) if text else []

    def expand(self, pieces: np.ndarray) -> np.ndarray:
        bare = np.flatnonzero(pieces < 0)
        if not len(bare):
            return pieces.astype(np.int32)
        n = np.ones(len(pieces), np.int64)
        codes, back = np.unique(-pieces[bare], return_inverse=True)
        spelt = [[self.byte[b] for b in chr(c).encode()] for c in codes.tolist()]
        n[bare] = np.array([len(x) for x in spelt])[back]
        out, at = np.repeat(pieces, n), (np.cumsum(n) - n)[bare]
        for j, x in enumerate(spelt):
            for m, i in enumerate(x):
                out[at[back == j] + m] = i
        return out.astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode([int(i) for i in ids])


def _hash(*parts) -> np.ndarray:
    h = np.uint64(0x1234567)
    for p in parts:
        h = mix((h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def _gumbel(h: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)))


def _capped(top: np.ndarray, g: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Gumbel values g, of which `most` is the largest, moved as if their largest were `top`."""
    v = top - g + np.log1p(-np.exp(np.minimum(g - most, -1e-12)))
    return top - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))


def _walk(lat: Lattices, node: np.ndarray, key: np.ndarray, occ: np.ndarray, depth: np.ndarray, salt: int):
    """From each node to its unit's end, always by the best child. Returns decisions (place, child), and their other
    children (decision, child, value, largest value beside it)."""
    base = _hash(key, occ, salt)
    decided: list[tuple[np.ndarray, ...]] = []
    others: list[tuple[np.ndarray, ...]] = []
    at = np.flatnonzero(node >= 0)
    cur, made, step = node[at], 0, 0
    while len(at):
        n = lat.count[cur]
        begin = np.cumsum(n) - n
        rep = np.repeat(np.arange(len(at)), n)
        nth = np.arange(len(rep)) - begin[rep]
        child = lat.first[cur][rep] + nth
        who = at[rep]
        g = lat.logp[child] + _gumbel(mix(base[who] ^ ((depth[who] + step) * 4096 + nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        most = np.maximum.reduceat(g, begin)
        best = np.flatnonzero(g == most[rep])
        if len(best) > len(at):
            best = best[np.flatnonzero(np.diff(rep[best], prepend=-1))]
        decided.append((at, child[best], np.full(len(at), step)))
        rest = np.ones(len(rep), bool)
        rest[best] = False
        others.append((made + rep[rest], child[rest], g[rest], most[rep[rest]]))
        made += len(at)
        cur = lat.next[child[best]]
        go = cur >= 0
        at, cur, step = at[go], cur[go], step + 1
    join = lambda parts, m: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * m
    return join(decided, 3), join(others, 4)


def sample_texts(lat: Lattices, keys: list[int | None], texts: list[str | None], k: int, seed: int) -> list[list[tuple]]:
    """For each text up to k of (ids, log probability, Gumbel value, inclusion)."""
    units = [lat.units(t) for t in texts]
    lat.release()
    lat.add(set(itertools.chain.from_iterable(units)).difference(lat.root))
    size = np.array([len(u) for u in units], np.int64)
    roots = np.fromiter(map(lat.root.__getitem__, itertools.chain.from_iterable(units)), np.int64, int(size.sum()))
    base = np.cumsum(size) - size
    key = np.array([(x or 0) & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64)
    top = _gumbel(_hash(key, seed))
    out: list[list[tuple]] = [[] for _ in texts]
    queue: list[list[tuple]] = [[] for _ in texts]
    # where each text's walk begins: path so far (children), unit, node, decisions made in the unit, log probability, Gumbel value
    todo = {d: (np.zeros(0, np.int64), 0, -2, 0, 0.0, float(top[d])) for d in range(len(texts))}
    for s in range(k):
        docs = np.array(list(todo), np.int64)
        start = np.array([todo[d][1] for d in docs], np.int64)
        n = size[docs] - start
        off = np.cumsum(n) - n
        of = np.repeat(np.arange(len(docs)), n)
        occ = start[of] + np.arange(len(of)) - off[of]
        node = roots[base[docs][of] + occ] if len(of) else np.zeros(0, np.int64)
        depth = np.zeros(len(of), np.int64)
        for i, d in enumerate(docs.tolist()):
            if todo[d][2] != -2 and n[i] > 0:
                node[off[i]], depth[off[i]] = todo[d][2], todo[d][3]
        (place, child, step), (from_, other, g, most) = _walk(lat, node, key[docs][of], occ, depth, (seed << 8) + s)
        order = np.lexsort((step, place))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, child, step = place[order], child[order], step[order]
        doc = of[place]
        logp = lat.logp[child] if len(child) else np.zeros(0)
        ends = np.searchsorted(doc, np.arange(len(docs)), "right")
        begins = np.searchsorted(doc, np.arange(len(docs)), "left")
        total = np.concatenate([[0.0], np.cumsum(logp)])
        phi0, tops = np.array([todo[d][4] for d in docs]), np.array([todo[d][5] for d in docs])
        before = total[:-1] - total[begins[doc]] + phi0[doc] if len(doc) else np.zeros(0)
        from_ = rank[from_]
        value = before[from_] + _capped(tops[doc[from_]] - before[from_], g, most) if len(from_) else np.zeros(0)
        ranked = np.lexsort((-value, doc[from_])) if len(from_) else np.zeros(0, np.int64)
        lo = np.searchsorted(doc[from_][ranked], np.arange(len(docs)), "left")
        hi = np.searchsorted(doc[from_][ranked], np.arange(len(docs)), "right")
        fresh = {}
        for i, d in enumerate(docs.tolist()):
            path0, _, _, _, phi, t = todo[d]
            path = np.concatenate([path0, child[begins[i] : ends[i]]])
            out[d].append((lat.expand(lat.piece[path]), phi + float(total[ends[i]] - total[begins[i]]), t))
            for r in ranked[lo[i] : min(hi[i], lo[i] + k - s)].tolist():
                f, c = int(from_[r]), int(other[r])
                p = int(place[f])
                heapq.heappush(queue[d], (-float(value[r]), s, r, path[: len(path0) + f - int(begins[i])], c, int(occ[p]), int(depth[p] + step[f]) + 1, float(before[f] + lat.logp[c])))
            if s + 1 < k and queue[d]:
                v, _, _, head, c, unit, made, phi = heapq.heappop(queue[d])
                after = int(lat.next[c])
                fresh[d] = (np.append(head, c), unit if after >= 0 else unit + 1, after if after >= 0 else -2, made if after >= 0 else 0, phi, -v)
        todo = fresh
        if not todo:
            break
    result = []
    for d, got in enumerate(out):
        cut = -queue[d][0][0] if queue[d] else -math.inf  # the best value left out
        result.append([(ids, phi, t, 1.0 if cut == -math.inf else -math.expm1(-math.exp(min(700.0, phi - cut)))) for ids, phi, t in got])
    return result


def sampled(docs: DataFrame, model: str, *, k=2, seed=1, id_col="doc_id", text_col="text") -> DataFrame:
    """id, sample (from 1), ids, log_prob, gumbel, inclusion: up to `k` distinct segmentations of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = resident((model, Lattices), lambda: Lattices(model))
        for batch in slices(batches, "text", 3 << 20):
            keys = batch.column("id").to_pylist()
            got = sample_texts(lat, keys, batch.column("text").to_pylist(), k, seed)
            rows = [(i, n + 1, *g) for i, gs in zip(keys, got, strict=True) for n, g in enumerate(gs)]
            flat = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32()), pa.array(flat))
            kinds = {"id": pa.int64(), "sample": pa.int32(), "ids": None, "log_prob": pa.float64(), "gumbel": pa.float64(), "inclusion": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) if t else ids for c, t in enumerate(kinds.values())], names=list(kinds))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SAMPLES)


def decoded(rows: DataFrame, model: str, *, ids_col="ids", out="text") -> DataFrame:
    """`rows` with the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = resident((model, Lattices), lambda: Lattices(model))
        for batch in batches:
            texts = [None if ids is None else lat.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(out)).schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    return found.select(F.col("id").alias("doc_id"), "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion")
