"""Finding what documents share without comparing documents: the common part of the two substring operators.

Documents are dealt by a hash of their id into chunks of about `CHUNK` bytes, so no chunk depends on how often a text occurs. A
chunk's anchors leave it as one packed row for each bucket of hash values, repeats within
the chunk already merged; a bucket therefore gets at most one entry for each chunk and anchor, however
many documents hold it. What a bucket finds goes back to the chunks by the same way. The chunked texts
are shuffled once: all passes over them read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, vacate

CHUNK = 8 << 20
LAST = np.iinfo(np.int64).max  # stands for a null id: no document is larger


class Chunks:
    """Documents as chunk (long), id (long), text (binary), and the number of buckets that suits their size."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first().n or 0
        self.n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK))
        self.buckets = max(1, 2 * self.n)
        named = F.col(id_col).cast("long")
        extra = [] if carry is None else [F.struct(F.lit(None).cast("int").alias("_wl"), *[F.when(F.lit(True), F.col(f"`{c}`")).alias(c) for c in carry]).alias("row")]
        self.texts = docs.select(F.pmod(F.xxhash64(named, F.lit("chunk")), F.lit(self.n)).alias("chunk"), F.coalesce(named, F.lit(LAST)).alias("id"), named.isNull().alias("unnamed"), F.col(text_col).cast("binary").alias("text"), *extra)

    def each(self, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.texts.groupBy("chunk").applyInArrow(work, schema)

    def with_notes(self, notes: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """`work` gets a chunk's texts and its rows of `notes` (chunk, ...)."""
        return self.texts.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(work, schema)


class Texts:
    """A chunk's documents: ids, all bytes in a row, and where each begins and ends."""

    def __init__(self, table: pa.Table):
        vacate()
        self.ids = np.asarray(table.column("id")).astype(np.int64)
        self.unnamed = np.asarray(table.column("unnamed"))
        self.raw, off = text_bytes(table.column("text"))
        self.start, self.end = off[:-1], off[1:]
        self.chunk = table.column("chunk")[0].as_py() if table.num_rows else None


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets that 64-bit keys fall into, and the places of the keys of each."""
    at = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(at, kind="stable")
    values, first = np.unique(at[order], return_index=True)
    return values.astype(np.int64), np.split(order, first[1:])


def offer(chunk: int, keys: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """A chunk's anchors: in each bucket the low halves of the distinct keys, and whether more than one document holds a key."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    first = np.flatnonzero(np.diff(k, prepend=~k[:1])) if len(k) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(k)) - 1
    uniq, many = k[first], d[first] != d[last]
    where, rows = split(uniq, buckets) if len(uniq) else ([], [])
    return pa.table(
        {
            "bucket": pa.array(where, pa.int64()),
            "from": pa.array([chunk] * len(where), pa.int64()),
            "keys": pa.array([uniq[r].astype(np.uint32).tobytes() for r in rows], pa.binary()),
            "many": pa.array([many[r].tobytes() for r in rows], pa.binary()),
        }
    )


OFFER = "bucket long, from long, keys binary, many binary"


def shared(offers: DataFrame) -> DataFrame:
    """chunk, bucket, keys: for each chunk its keys that another chunk, or more than one of its own documents, holds. (32 bits of a key in
    a bucket tell keys apart but for about one in 5000; a key that only seems shared costs a comparison and changes nothing.)"""

    def find(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        keys, many = np.concatenate(parts), np.frombuffer(b"".join(table.column("many").to_pylist()), bool)
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        keep = (n[back] > 1) | many
        ends = np.cumsum([len(p) for p in parts])
        out = [(c, p[keep[e - len(p) : e]].tobytes()) for c, p, e in zip(table.column("from").to_pylist(), parts, ends, strict=True)]
        out = [x for x in out if x[1]]
        b = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([b] * len(out), pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary())})

    return offers.groupBy("bucket").applyInArrow(find, "chunk long, bucket long, keys binary")


def known(table: pa.Table) -> np.ndarray:
    """A chunk's shared keys as sorted numbers, to be looked up with `is_known`."""
    parts = [np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, k in zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def is_known(keys: np.ndarray, sorted_known: np.ndarray, buckets: int) -> np.ndarray:
    if not len(sorted_known):
        return np.zeros(len(keys), bool)
    look = (keys & np.uint64(0xFFFFFFFF)) | ((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)
    return sorted_known[np.minimum(np.searchsorted(sorted_known, look), len(sorted_known) - 1)] == look


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0
