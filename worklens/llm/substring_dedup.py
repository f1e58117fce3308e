"""Repeated word windows by difference-cover anchors.

`COVER` is a difference cover modulo `PERIOD`: any two places have a shift under PERIOD that takes both onto cover
positions. So of two equal windows of `window` words, wherever they begin, both hold the same run of
window - PERIOD + 1 words at a cover position. Only runs at cover positions are hashed and exchanged between chunks. A run that two documents
hold is extended: every window around it is hashed whole, and the bucket of that hash finds the least document with
the window. A word goes if a window that covers it also starts in a document with a smaller id.

Words are compared by their XXH3 hashes of 64 bits, windows by 64-bit hashes mixed from their words'; texts aren't compared again.

Cases: a null text has no words; texts under `window` words keep all. Rows with a null id come after all others. Repeated rows with one id are
one document: they don't remove each other. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import OFFER, Chunks, Texts, covered, is_known, known, mix, offer, shared, split

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every remainder modulo 31 is a difference of two of these

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def _runs(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` values: halves are joined and mixed again and again, so that the hash is no sum whose terms could cancel out."""
    out, done, step, part = None, 0, 1, values
    while True:
        if size & step:
            out, done = (part, step) if out is None else (_joined(out, part[done:]), done + step)
        step *= 2
        if step > size:
            return out[: max(0, len(values) - size + 1)]
        part = _joined(part, part[step // 2 :])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return mix((a[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ mix(b[:n] + np.uint64(0xD6E8FEB86659FD93)))


class _Words:
    """A chunk's words: where each begins and ends, its document, and its hash."""

    def __init__(self, t: Texts):
        black = ~_space[t.raw]
        edge = np.zeros(len(t.raw) + 1, bool)
        edge[t.start] = True
        first = black.copy()
        first[1:] &= ~black[:-1] | edge[1:-1]
        last = black.copy()
        last[:-1] &= ~black[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        # bytes.split() parts at exactly the bytes that _space marks
        words = itertools.chain.from_iterable(t.raw[a:b].tobytes().split() for a, b in zip(t.start.tolist(), t.end.tolist(), strict=True))
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(self.begin))
        # words of document d: from[d] to to[d]
        self.start, self.stop = np.searchsorted(self.begin, t.start, "left"), np.searchsorted(self.begin, t.end, "left")
        self.doc = np.repeat(np.arange(len(t.ids)), self.stop - self.start)
        self.place = np.arange(len(self.begin)) - self.start[self.doc]
        self.left = self.stop[self.doc] - np.arange(len(self.begin))  # words from here to the document's end


def _cover_runs(w: _Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.isin(w.place % PERIOD, COVER) & (w.left >= size))
    return at, _runs(w.hash, size)[at]


def removed_words(docs: DataFrame, *, id_col="doc_id", text_col="text", window=50) -> DataFrame:
    """Per row of `docs`: id, n_words, n_removed, kept (the remaining words, joined by one space)."""
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    chunks, run = Chunks(docs, id_col, text_col), window - PERIOD + 1
    buckets = chunks.buckets

    def hashes(table: pa.Table) -> pa.Table:
        t = Texts(table)
        w = _Words(t)
        at, key = _cover_runs(w, run)
        return offer(t.chunk, key, t.ids[w.doc[at]], buckets)

    def extend(table: pa.Table, notes: pa.Table) -> pa.Table:
        t, out = Texts(table), []
        if t.chunk is not None and notes.num_rows:
            w = _Words(t)
            at, key = _cover_runs(w, run)
            at = at[is_known(key, known(notes), buckets)]
            # every window that holds such a run whole, beginning up to PERIOD - 1 words before it
            near = covered(len(w.begin), np.maximum(at - PERIOD + 1, w.start[w.doc[at]]), at + 1)
            at = np.flatnonzero(near & (w.left >= window))
            key, ids = _runs(w.hash, window)[at], t.ids[w.doc[at]]
            order = np.lexsort((ids, key))
            pick = order[np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))] if len(order) else order
            many = np.zeros(len(pick), bool)
            if len(pick):
                ends = np.append(np.searchsorted(key[order], key[pick], "right"), 0)[:-1] - 1
                many = ids[order[ends]] != ids[pick]
            where, parts = split(key[pick], buckets) if len(pick) else ([], [])
            out = [(int(b), t.chunk, key[pick[p]].tobytes(), ids[pick[p]].tobytes(), many[p].tobytes()) for b, p in zip(where, parts, strict=True)]
        return pa.table({n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate((("bucket", pa.int64()), ("from", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("many", pa.binary())))})

    def least(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys, ids, many = np.concatenate(parts), np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64), np.frombuffer(b"".join(table.column("many").to_pylist()), bool)
        uniq, back = np.unique(keys, return_inverse=True)
        low = np.full(len(uniq), np.iinfo(np.int64).max)
        np.minimum.at(low, back, ids)
        keep = (low[back] < ids) | many  # else the chunk has the least document alone
        ends = np.cumsum([len(p) for p in parts])
        out = []
        for c, p, e in zip(table.column("from").to_pylist(), parts, ends, strict=True):
            s = slice(e - len(p), e)
            if keep[s].any():
                out.append((c, p[keep[s]].tobytes(), low[back[s]][keep[s]].tobytes()))
        return pa.table({n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate((("chunk", pa.int64()), ("keys", pa.binary()), ("least", pa.binary())))})

    def cut(table: pa.Table, notes: pa.Table) -> pa.Table:
        t = Texts(table)
        w = _Words(t)
        gone = np.zeros(len(w.begin), bool)
        if len(w.begin) and notes.num_rows:
            keys, low = np.frombuffer(b"".join(notes.column("keys").to_pylist()), np.uint64), np.frombuffer(b"".join(notes.column("least").to_pylist()), np.int64)
            order = np.argsort(keys)
            keys, low = keys[order], low[order]
            at = np.flatnonzero(w.left >= window)
            mine = _runs(w.hash, window)[at]
            i = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            at = at[(keys[i] == mine) & (low[i] < t.ids[w.doc[at]])]
            gone = covered(len(gone), at, at + window)
        kept = []
        for a, b in zip(w.start.tolist(), w.stop.tolist(), strict=True):
            words = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([t.raw[x:y].tobytes() for x, y in zip(w.begin[words].tolist(), w.end[words].tolist(), strict=True)]))
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.start, len(gone))) if len(w.start) else np.zeros(0, np.int64)
        n_removed = np.where(w.stop > w.start, n_removed, 0)
        return pa.table({"id": pa.array(t.ids, mask=t.unnamed), "n_words": pa.array(w.stop - w.start, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    seen = shared(chunks.each(hashes, OFFER))
    wide = chunks.with_notes(seen, extend, "bucket long, from long, keys binary, ids binary, many binary")
    found = wide.groupBy("bucket").applyInArrow(least, "chunk long, keys binary, least binary")
    return chunks.with_notes(found, cut, "id long, n_words long, n_removed long, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
