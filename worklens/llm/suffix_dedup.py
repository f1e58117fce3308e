"""Exact repeats of `min_len` bytes by a common-prefix interval tree over an enhanced suffix array.

1. Anchors. In every run of `min_len` - `K` + 1 neighbouring K-byte strings the one of the least hash is an
   anchor (winnowing), so any two equal strings of `min_len` bytes hold an equal anchor at the same place. Chunks
   exchange the anchors' hashes, and only anchors that two documents hold go on.
2. Suffixes. Each such anchor brings its surroundings: all bytes that a string of `min_len` bytes around it can
   reach. Equal surroundings are merged with their least document id. All surroundings of an anchor meet in one bucket. There the suffixes that
   begin where left extensions differ are sorted; the stack scan over the common prefixes of neighbours gives the
   interval tree, and each interval of `min_len` or more whose members have different left neighbours (or reach the edge of the surroundings)
   is a maximal repeat, with all its occurrences.
3. Removal. A group's occurrences in documents other than its least one are marked, and marks are united in each document.

A byte goes if a string of `min_len` bytes that covers it also starts in a document with a smaller id.

Cases: a null text counts as empty; texts under `min_len` bytes keep all. Rows with a null id come after all others. Repeated rows
with one id are one document: they don't remove each other. Matches never cross documents. Texts must not hold the byte 255, which UTF-8 never has.
Extra columns are ignored; in the pipeline's stage they stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import OFFER, Chunks, Texts, covered, is_known, known, mix, offer, shared, split
from .common import spread, squeezed

K = 20
PAD = 255


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of w values."""
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


PART = 1 << 20


def anchors(t: Texts, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, document number and 64-bit hash of each anchor. Anchors depend on their own document alone, so whole documents go by parts of about PART bytes."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none.astype(np.uint64))]
    first = np.flatnonzero(np.diff(t.start // PART, prepend=-1)) if len(t.start) else none
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(t.start)], strict=True):
        begin = t.start[a]
        at, doc, key = _anchors(t.raw[begin : t.end[b - 1]], t.start[a:b] - begin, t.end[a:b] - begin, min_len)
        found.append((at + begin, doc + a, key))
    at, doc, key = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, doc, key


def _anchors(raw: np.ndarray, start: np.ndarray, end: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, w = len(raw), min_len - K + 1
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none.astype(np.uint64)
    four = np.ndarray((n - 3,), "<u4", np.ascontiguousarray(raw), strides=(1,)).copy()
    m = n - K + 1
    h = four[:m] * np.uint32(0x9E3779B1)
    for j, c in zip(range(4, K, 4), (0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1), strict=True):
        h += four[j : j + m] * np.uint32(c)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    np.maximum(h, 1, out=h)
    low = _slide(h, w, np.minimum) if w > 1 else h.copy()
    # runs that cross a document's end don't count
    gone = np.zeros(len(low) + 1, np.int32)
    cut = np.clip(np.maximum(end - min_len + 1, start), 0, len(low))
    np.add.at(gone, cut, 1)
    np.add.at(gone, np.clip(end, 0, len(low)), -1)
    low[np.cumsum(gone[:-1], dtype=np.int32) > 0] = 0
    edge = np.zeros(w - 1, np.uint32)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum)[:m] == h)
    doc = np.searchsorted(end, at, "right")
    return at, doc, _key([four[at + j] for j in range(0, K, 4)])


def _key(parts: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of anchors, each given as K / 4 numbers of 32 bits."""
    key = np.zeros(len(parts[0]), np.uint64)
    for x, c in zip(parts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F), strict=True):
        key = (key ^ x.astype(np.uint64)) * np.uint64(c)
        key ^= key >> np.uint64(29)
    return mix(key)


def _lead(same: np.ndarray) -> np.ndarray:
    """How many values at the head of each row are true."""
    if not same.size:
        return np.zeros(len(same), np.int64)
    first = same.argmin(axis=1)
    return np.where(same[np.arange(len(same)), first], same.shape[1], first)


def surroundings(t: Texts, at: np.ndarray, doc: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from min_len - K before each anchor to min_len after its start, other documents' bytes as PAD; and their hashes."""
    left, width = min_len - K, 2 * min_len - K
    first = at - left
    out = np.empty((len(at), -(-width // 8) * 8), np.uint8)
    out[:, width:] = PAD
    cols = np.arange(width)
    for a in range(0, len(at), 1 << 14):
        s = slice(a, a + (1 << 14))
        where = first[s, None] + cols
        inside = (where >= t.start[doc[s], None]) & (where < t.end[doc[s], None])
        out[s, :width] = np.where(inside, t.raw[np.clip(where, 0, len(t.raw) - 1)], PAD)
    return out, _hash_rows(out)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    words, h = rows.view(np.uint64), np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return mix(h)


def _heads(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where a new surrounding begins in an order by hash; bytes decide, so that equal hashes alone join nothing."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
    return np.flatnonzero(new)


def intervals(lcp: np.ndarray, least: np.ndarray, diverse: np.ndarray, min_len: int) -> list[tuple[int, int, int, int]]:
    """The maximal repeats of a suffix array: (first, last, length, least document) of each interval of the common-prefix
    tree with length >= min_len whose left neighbours differ.

    lcp[i]: bytes that suffixes i-1 and i share (lcp[0] unused); least[i]: the least document of suffix i;
    diverse[i]: left[i] differs from left[i-1], or suffix i begins at an edge.
    """
    out, stack, n = [], [], len(least)
    lcps, docs, div = lcp.tolist(), least.tolist(), diverse.tolist()
    # an open interval: length, first, least document, left neighbours differ
    for i in range(1, n + 1):
        now = lcps[i] if i < n else 0
        if now < min_len:
            now = 0
        first, low, wide = i - 1, docs[i - 1], False
        while stack and stack[-1][0] > now:
            size, begin, least_doc, differ = stack.pop()
            low, wide = min(low, least_doc), wide or differ
            first = begin
            if wide:
                out.append((begin, i - 1, size, low))
        if now:
            joins = div[i]
            if stack and stack[-1][0] == now:
                size, begin, least_doc, differ = stack[-1]
                stack[-1] = (size, begin, min(low, least_doc, docs[i]), differ or wide or joins)
            else:
                stack.append((now, first, min(low, docs[i]), wide or joins))
        elif stack:
            raise AssertionError("open interval under min_len")
    return out


def repeats(rows: np.ndarray, group: np.ndarray, least: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Maximal repeats among the distinct surroundings of each anchor: row, begin, end, least document, one for each occurrence."""
    left, width = min_len - K, 2 * min_len - K
    begin = left - _lead((rows[:, :left] != PAD)[:, ::-1])
    end = left + _lead(rows[:, left:width] != PAD)
    # a surrounding that several documents hold repeats as a whole
    all_rows = np.flatnonzero(end - begin >= min_len)
    found = [(all_rows, begin[all_rows], end[all_rows], least[all_rows])]
    _, back, n = np.unique(group, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[back] > 1)
    if len(some):
        # where left extensions differ: bytes that neighbours in the order of their reversed left parts share
        turned = np.ascontiguousarray(rows[some, :left][:, ::-1])
        order = np.argsort(turned.view(f"S{left}").ravel(), kind="stable") if left else np.arange(len(some))
        order = order[np.argsort(back[some][order], kind="stable")]
        some, turned = some[order], turned[order]
        same = _lead(turned[1:] == turned[:-1])
        room = left - begin[some]
        same = np.minimum(same, np.minimum(room[1:], room[:-1]))
        together = back[some][1:] == back[some][:-1]
        starts = np.unique(back[some][1:][together] * 256 + same[together])
        g, depth = starts // 256, starts % 256
        # every suffix that begins at such a place
        lo, hi = np.searchsorted(back[some], g, "left"), np.searchsorted(back[some], g, "right")
        which = np.repeat(np.arange(len(g)), hi - lo)
        member = some[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]
        at = left - depth[which]
        ok = (at >= begin[member]) & (end[member] - at >= min_len)
        which, member, at = which[ok], member[ok], at[ok]
        for a, b in _cuts(which, 1 << 16):
            found.append(_scan(rows, which[a:b], member[a:b], at[a:b], begin, end, least, min_len, width))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cuts(which: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of about `size` places that don't part equal values."""
    ends, a, out = np.append(np.flatnonzero(np.diff(which)) + 1, len(which)), 0, []
    for e in ends[np.searchsorted(ends, np.arange(size, len(which) + size, size)).clip(max=len(ends) - 1)].tolist() if len(which) else []:
        if e > a:
            out.append((a, e))
            a = e
    return out


def _scan(rows, which, member, at, begin, end, least, min_len, width):
    text = np.zeros((len(at), width), np.uint8)
    for a in np.unique(at).tolist():  # few starts: one copy of a range of columns for each
        mine = np.flatnonzero(at == a)
        text[mine, : width - a] = rows[member[mine], a:width]
    text[np.arange(width, dtype=np.int16) >= (end[member] - at).astype(np.int16)[:, None]] = 0
    order = np.argsort(text.view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(which[order], kind="stable")]
    which, member, at, text = which[order], member[order], at[order], text[order]
    lcp = np.zeros(len(which), np.int64)
    size = end[member] - at
    lcp[1:] = np.minimum(_lead(text[1:] == text[:-1]), np.minimum(size[1:], size[:-1]))
    lcp[1:][which[1:] != which[:-1]] = 0
    edge = at == begin[member]
    before = np.where(edge, -1, rows[member, np.maximum(at - 1, 0)].astype(np.int64))
    diverse = edge.copy()
    diverse[1:] |= edge[:-1] | (before[1:] != before[:-1])
    groups = intervals(lcp, least[member], diverse, min_len)
    if not groups:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    first, last, length, low = (np.array(x, np.int64) for x in zip(*groups, strict=True))
    n = last - first + 1
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return member[place], at[place], at[place] + np.repeat(length, n), np.repeat(low, n)


def removed_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", min_len=50, carry: list[str] | None = None) -> DataFrame:
    """Per row of `docs`: id, n_bytes, spans (the maximal removed runs, array of begin and end), kept (the remaining bytes).

    With `carry`, names of other columns, `row` holds these, kept_text the remaining text, and void says that the text was null.
    """
    if not K <= min_len <= 200:
        raise ValueError(f"min_len must be from {K} to 200")
    chunks = Chunks(docs, id_col, text_col, carry)
    buckets, width = chunks.buckets, -(-(2 * min_len - K) // 8) * 8

    def hashes(table: pa.Table) -> pa.Table:
        t = Texts(table)
        _, doc, key = anchors(t, min_len)
        return offer(t.chunk, key, t.ids[doc], buckets)

    def bring(table: pa.Table, notes: pa.Table) -> pa.Table:
        t, out = Texts(table), []
        if t.chunk is not None and notes.num_rows:
            at, doc, key = anchors(t, min_len)
            go = is_known(key, known(notes), buckets)
            at, doc, key = at[go], doc[go], key[go]
            rows, h = surroundings(t, at, doc, min_len)
            order = np.lexsort((t.ids[doc], h))
            pick = order[_heads(h[order], rows[order])]
            where, parts = split(key[pick], buckets) if len(pick) else ([], [])
            out = [(int(b), t.chunk, squeezed(t.ids[doc[pick[p]]]), squeezed(rows[pick[p]])) for b, p in zip(where, parts, strict=True)]
        return pa.table({n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate((("bucket", pa.int64()), ("from", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary())))})

    def compare(table: pa.Table) -> pa.Table:
        ids = spread(table.column("ids").to_pylist(), np.int64)
        came = np.repeat(np.asarray(table.column("from")), [len(x) for x in ids])
        ids, rows = np.concatenate(ids), np.concatenate(spread(table.column("rows").to_pylist(), np.uint8)).reshape(-1, width)
        h = _hash_rows(rows)
        order = np.lexsort((ids, h))
        head = _heads(h[order], rows[order])
        one = order[head]  # each distinct surrounding, by its least document
        span = np.diff(np.append(head, len(order)))
        group = _hash_rows(np.ascontiguousarray(np.pad(rows[one][:, min_len - K : min_len], ((0, 0), (0, 4)))))
        row, begin, end, low = repeats(rows[one], group, ids[one], min_len)
        # an occurrence is told back if a smaller document has it than the first holder of the whole surrounding, or is the whole (each row's first)
        tell = low < ids[one][row]
        tell[np.unique(row, return_index=True)[1]] = True
        row, begin, end, low = (x[tell] for x in (row, begin, end, low))
        # back to every chunk that brought the surrounding
        n = span[row]
        to = order[np.repeat(head[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        back = np.repeat(np.arange(len(row)), n)
        by = np.argsort(came[to], kind="stable")
        to, back = to[by], back[by]
        anchor = np.ascontiguousarray(rows[:, min_len - K : min_len]).view("<u4")
        key = _key([anchor[:, j] for j in range(K // 4)])
        values, first = np.unique(came[to], return_index=True)
        parts = np.split(np.arange(len(to)), first[1:]) if len(values) else []
        return pa.table(
            {
                "chunk": pa.array(values, pa.int64()),
                "keys": pa.array([squeezed(np.unique(key[to[p]])) for p in parts], pa.binary()),
                "hash": pa.array([squeezed(h[to[p]]) for p in parts], pa.binary()),
                "begin": pa.array([squeezed(begin[back[p]].astype(np.uint16)) for p in parts], pa.binary()),
                "end": pa.array([squeezed(end[back[p]].astype(np.uint16)) for p in parts], pa.binary()),
                "least": pa.array([squeezed(low[back[p]]) for p in parts], pa.binary()),
            }
        )

    def cut(table: pa.Table, notes: pa.Table) -> pa.Table:
        t = Texts(table)
        gone = np.zeros(len(t.raw), bool)
        if t.chunk is not None and notes.num_rows:
            h, begin, end, least = (np.concatenate(spread(notes.column(c).to_pylist(), kind)) for c, kind in (("hash", np.uint64), ("begin", np.uint16), ("end", np.uint16), ("least", np.int64)))
            order = np.argsort(h, kind="stable")
            h, begin, end, least = h[order], begin[order].astype(np.int64), end[order].astype(np.int64), least[order]
            at, doc, key = anchors(t, min_len)
            told = np.sort(np.concatenate(spread(notes.column("keys").to_pylist(), np.uint64)))
            go = told[np.minimum(np.searchsorted(told, key), len(told) - 1)] == key
            at, doc = at[go], doc[go]
            _, mine = surroundings(t, at, doc, min_len)
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            n = hi - lo
            a = np.repeat(np.arange(len(at)), n)
            r = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ok = least[r] < t.ids[doc[a]]
            a, r = a[ok], r[ok]
            gone = covered(len(t.raw), at[a] - (min_len - K) + begin[r], at[a] - (min_len - K) + end[r])
        out = []
        for s, e in zip(t.start.tolist(), t.end.tolist(), strict=True):
            mask = gone[s:e]
            turn = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2)
            raw = t.raw[s:e]
            out.append(([{"begin": int(a), "end": int(b)} for a, b in turn], (raw[~mask] if len(turn) else raw).tobytes()))
        ids = pa.array(t.ids, mask=t.unnamed)
        spans = pa.array([x[0] for x in out], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        cols = {"id": ids, "n_bytes": pa.array(t.end - t.start), "spans": spans, "kept": pa.array([x[1] for x in out], pa.binary())}
        if carry is not None:
            cols["kept"] = pa.nulls(len(ids), pa.binary())
            cols |= {"kept_text": pa.array([x[1].decode("utf-8", "ignore") for x in out], pa.string()), "void": table.column("text").is_null(), "row": table.column("row")}
        return pa.table(cols)

    seen = shared(chunks.each(hashes, OFFER))
    brought = chunks.with_notes(seen, bring, "bucket long, from long, ids binary, rows binary")
    found = brought.groupBy("bucket").applyInArrow(compare, "chunk long, keys binary, hash binary, begin binary, end binary, least binary")
    schema = "id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    if carry is not None:
        schema += f", kept_text string, void boolean, row {chunks.texts.schema['row'].dataType.simpleString()}"
    return chunks.with_notes(found, cut, schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_len: int = 50) -> DataFrame:
    """Pipeline stage: every document keeps the part of its text that op3 keeps, be it empty; a null text stays null, n_chars follows the text.

    A cut can part a character of several bytes; what is left of such a character goes too.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = removed_spans(docs, min_len=min_len, carry=rest).withColumn("text", F.when(~F.col("void"), F.col("kept_text")))
    columns = {"doc_id": F.col("id"), "text": F.col("text")} | {c: F.col(f"row.`{c}`") for c in rest}
    if "n_chars" in rest:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
