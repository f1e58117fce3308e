"""Exact top-k inner products by a bit-sliced index.

Every component x becomes floor(scale * x). A block of rows keeps, for each attribute and bit, one bitmap over its rows (the
slices of the value less the block's minimum). A query's weights are added bit by bit: slice b of an attribute goes, for each set
bit j of the weight's magnitude, into column b + j (complemented, if the weight is negative), and full adders on whole bitmaps reduce each
column to one bitmap, carrying into the next. The k best rows are then picked from the most significant bitmap
downward; the rows still level at the end are the boundary, and ids decide among them.

Rows are dealt to blocks by hash, queries to blocks too; each pair of blocks is one group, and its best k of each query meet in a window.

Cases: vectors that are null or hold a null or non-finite component take no part. Sums that may pass 63 bits are made with Python's integers; a score
past the range of a long stands at its end, and so does a scaled component past the range of a double. Vectors of different lengths don't meet. Rows that repeat an id count once (the least vector); a row with a null id takes no part. Ties go to smaller ids. Fewer
than k candidates: all. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

WHOLE, LONG = float(1 << 53), float(1 << 62)  # from WHOLE on every double is an integer
FAR = float(np.finfo(np.float64).max)


def quantised(rows: DataFrame, *, id_col="vec_id", vec_col="embedding", scale=1024) -> DataFrame:
    """id, v (array of double, all of them integers) of the rows that take part."""

    def level(x):
        y = F.least(F.greatest(x.cast("double") * scale, F.lit(-FAR)), F.lit(FAR))
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)

    x = F.col(vec_col)
    v = F.transform(x, level)
    fine = x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return rows.filter(fine & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Integers of 64 bits, or Python's where one needs more."""
    arr = column.combine_chunks()
    x = np.asarray(arr.flatten()).reshape(len(arr), d)
    return x.astype(np.int64) if not x.size or np.abs(x).max() < LONG else np.vectorize(int, otypes=[object])(x)


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as longs; exact wherever they fit."""
    if v.dtype != object and q.dtype != object and (np.abs(v.astype(np.float64)) @ np.abs(q.astype(np.float64)) < LONG).all():
        return v @ q
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, q, strict=True)), ends.min), ends.max) for row in v], np.int64)


def _bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, row 0 in the lowest bit."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), bool)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """The bitmaps of a block of rows (ids ascending)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.n = ids, v, len(ids)
        self.low = v.min(axis=0) if len(v) else np.zeros(v.shape[1], v.dtype)
        u = v - self.low
        self.depth = max(1, int(u.max()).bit_length()) if u.size else 1
        self.slices = _bitmaps(np.stack([(u >> b & 1).astype(bool).T for b in range(self.depth)], axis=1))  # attribute, bit, words
        self.all = _bitmaps(np.ones(self.n, bool))

    def add(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the weighted sums (less a constant), least significant first."""
        size, negative = np.abs(q), q < 0
        source = self.slices.copy()
        source[negative] = self.all & ~source[negative]
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length() if len(size) else 0):
            chosen = source[(size >> j & 1).astype(bool)]
            if len(chosen):
                for b in range(self.depth):
                    columns.setdefault(b + j, []).append(chosen[:, b])
        out, w = [], 0
        while columns:
            stack = np.concatenate(columns.pop(w)) if w in columns else np.zeros((1, len(self.all)), np.uint64)
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    part = a ^ b
                    carry, total, rest = (a & b) | (c & part), part ^ c, stack[3 * third :]
                else:
                    carry, total, rest = stack[:1] & stack[1:2], stack[:1] ^ stack[1:2], stack[2:]
                columns.setdefault(w + 1, []).append(carry)
                stack = np.concatenate([total, rest])
            out.append(stack[0])
            w += 1
        return out

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the one with id `own`; among equals the smallest ids."""
        level = self.all.copy()
        i = int(np.searchsorted(self.ids, own))
        if i < self.n and self.ids[i] == own:
            level[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        taken = np.zeros_like(level)
        for s in reversed(self.add(q)):
            more = taken | (level & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                level = level & s
            else:
                taken, level = more, level & ~s
                if n == k:
                    level = np.zeros_like(level)
                    break
        rows, edge = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (taken, level))
        rows = np.concatenate([rows, edge[: max(0, k - len(rows))]])
        return self.ids[rows], _products(self.v[rows], q)


def top_inner_products(rows: DataFrame, queries: Column, *, k=10, block=8192, query_block=1024) -> DataFrame:
    """query_id, rank, id, score: `rows` (id, v) with the largest inner product, for each row that `queries` (a condition on id) names."""
    rows = stash(rows.withColumn("d", F.size("v")))
    asked = rows.filter(queries)
    row_blocks, query_blocks = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // query_block))
    at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    left = rows.select("d", at(row_blocks, "rows").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"), "id", "v")
    right = asked.select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("r"), at(query_blocks, "queries").alias("q"), "id", "v")

    def find(data: pa.Table, asks: pa.Table) -> pa.Table:
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if data.num_rows and asks.num_rows:
            d = data.column("d")[0].as_py()
            data = data.sort_by("id")
            index = SlicedBlock(np.asarray(data.column("id")).astype(np.int64), _matrix(data.column("v"), d))
            for own, q in zip(np.asarray(asks.column("id")).tolist(), _matrix(asks.column("v"), d), strict=True):
                ids, scores = index.top(q, own, k)
                got.append((np.full(len(ids), own), ids, scores))
        cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), cols, strict=True)})

    found = left.groupBy("d", "r", "q").cogroup(right.groupBy("d", "r", "q")).applyInArrow(find, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_inner_products(rows, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")


OP7_SQL = """
with e as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from e q join e c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
  where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
