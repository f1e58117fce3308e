"""Whitening of embeddings by a factor of their scatter.

Components become integers, x = floor(1024 * c) + 100000. One pass over the vectors sums them exactly; a second centres every vector by those sums, as
n * x - S in whole numbers, before it multiplies, and adds the scatter up by cells. What remains is as large as a vector is long, whatever the
number of rows: a Cholesky factor of the scatter with diagonal pivots, and one-sided Jacobi rotations on the columns of that factor itself, never on
the scatter, so that small eigenvalues keep their relative accuracy. When all columns are orthogonal their squared lengths are the eigenvalues and
the columns over their lengths are the components. The last pass projects every vector.

Cases: vectors that are null or hold a null or non-finite entry take no part. Repeated rows, rows with a repeated or a null id are rows like others. Vectors
shorter than the longest count as if zeros followed. A direction without variance (of the scatter's numerical rank) has no unit to be scaled by and is no component, so
equal vectors, a single vector or an empty table give no rows. Eigenvalues that are equal let components turn among each other; any choice is right. Entries whose
scaled value passes 2^62 stand there, deviations past the range of a long at its end. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

LONG = 1 << 62
BLOCK = 4096  # vectors that are widened to doubles at once


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S, and unit components (rows) with their eigenvalues, largest first; trace: the sum of all eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def scaled(rows: DataFrame, *, id_col="vec_id", vec_col="embedding", scale=1024, shift=100_000) -> DataFrame:
    """id, x (array of long) of the rows that take part."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    end = float(LONG)
    level = lambda c: (F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-end)), F.lit(end))).cast("long") + shift)
    return rows.filter(fine).select(F.col(id_col).alias("id"), F.transform(v, level).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix of `d` columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            lists = part.column(part.schema.get_field_index("x"))
            sizes = np.asarray(lists.value_lengths())
            x = np.zeros((part.num_rows, d), np.int64)
            x[np.arange(d) < sizes[:, None]] = np.asarray(lists.flatten())
            yield part, x


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers, or Python's where they wouldn't do."""
    most = max((abs(int(s)) for s in sums), default=0)
    if x.size and max(int(x.max()), -int(x.min())) * n + most >= LONG:
        return x.astype(object) * n - sums
    return x * n - sums.astype(np.int64)


def _squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares along rows, exact wherever a long holds them."""
    most = max((abs(int(y.max())), abs(int(y.min())))) if y.size else 0
    if y.dtype != object and most * most * max(1, y.shape[1]) < LONG:
        return (y * y).sum(axis=1)
    return np.array([min(sum(int(v) ** 2 for v in row), (1 << 63) - 1) for row in y], np.int64)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor G with G @ G.T = `a` (symmetric, no negative eigenvalue): at each step the largest remaining diagonal entry is the pivot; it ends at the numerical rank.
    Rows keep the order of `a`, so G is lower triangular up to the order in which pivots were taken."""
    d = len(a)
    rest = np.diag(a).astype(np.float64).copy()
    floor = d * np.finfo(np.float64).eps * (rest.max() if d else 0.0)
    g, left = np.zeros((d, d)), np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(left, rest, -np.inf)))
        if not rest[p] > floor:
            return g[:, :k]
        left[p] = False
        g[p, k] = np.sqrt(rest[p])
        g[left, k] = (a[left, p] - g[left, :k] @ g[p, :k]) / g[p, k]
        rest[left] -= g[left, k] ** 2
    return g


def jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`g` with its columns rotated in pairs until all are orthogonal to each other. Pairs of a round share no column and turn at once."""
    g = g.copy()
    r = g.shape[1]
    ring = list(range(r + r % 2))  # an odd number of columns gets a free one
    tiny = max(1, len(g)) * np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(a, b) < r]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(c) > tiny * np.sqrt(a * b)
            if not off.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            t = np.where(off, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[:, i], g[:, j] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            return g
    raise ArithmeticError("columns did not become orthogonal")


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (rows) and eigenvalues of a covariance, largest first, up to its numerical rank."""
    g = jacobi(pivoted_cholesky(v))
    e = (g * g).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    return (g[:, order] / np.sqrt(e[order])).T, e[order]


def fit(vectors: DataFrame, components: int = 8) -> Whitening:
    """The whitening of all rows of `vectors` (x). The driver gets rows of the scatter by dimensions, never by vectors."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = size.n, size.d or 0
    if not n or not d:
        return Whitening(n, (), np.zeros((0, d)), np.zeros(0), 0.0)

    def add_up(batches):
        total = [0] * d
        for _, x in _blocks(batches, d):
            # halves of 31 bits: their sums over a block fit 64 bits whatever the values
            total = [t + (int(h) << 31) + int(m) for t, h, m in zip(total, (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array(total, pa.decimal128(38, 0))})

    sums = {r.i: int(r.s) for r in vectors.select("x").mapInArrow(add_up, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    s = np.array([sums[i] for i in range(d)], object)

    def scatter(batches):
        total = np.zeros((d, d))
        for _, x in _blocks(batches, d):
            y = _centred(x, n, s).astype(np.float64) / n
            total += y.T @ y
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    v = np.zeros((d, d))
    for r in vectors.select("x").mapInArrow(scatter, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        v[r.i, r.j] = v[r.j, r.i] = r.v / n
    units, e = eigen(v)
    return Whitening(n, tuple(s.tolist()), units[:components], e[:components], float(np.trace(v)))


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation, w (array of double: a coordinate for each component) of `vectors` (id, x)."""
    s, d, n = np.array(model.sums, object), len(model.sums), model.n
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T if len(model.eigenvalues) else np.zeros((d, 0))

    def project(batches):
        for part, x in _blocks(batches, d):
            y = _centred(x, n, s)
            w = (y.astype(np.float64) / n) @ turn
            w = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64())) if w.shape[1] else pa.array([[]] * len(w), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(_squares(y), pa.int64()), w], names=["id", "deviation", "w"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "x").mapInArrow(project, f"id {kind}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of w (divisor: all rows, centred before multiplying) less the identity."""
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    if not cells:
        return 0.0
    w = F.col("w")
    row = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stash(scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    model = fit(vectors)
    rows = stash(whiten(vectors, model))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    error = identity_error(rows, len(model.eigenvalues))
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
