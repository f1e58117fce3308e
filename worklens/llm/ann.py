"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Equal vectors are one node of the graph, which keeps its smallest ids. The graph begins with the neighbours that vectors find in
blocks of random hyperplanes. A round of NN-descent joins each node's neighbours and reverse neighbours with their vectors, compares
them with each other (neighbours of neighbours), and offers each the better ones; every node keeps its `k` best. A query's search
begins at its own node, follows the links (neighbours and the `k` nearest reverse neighbours) of the `beam` best nodes found so far, and
ends when none of them is new. The best beam is scored once more by the cosine of the original vectors in double precision.

A query's work depends on `beam` and `k`, not on the number of vectors, so the work of all grows with their number. Vectors travel as unit
vectors of 32-bit floats during descent and search, so that near copies keep their order, and are multiplied in double precision.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part; shorter vectors count as filled up with zeros. Rows that
repeat an id count once (the least vector); a row with a null id takes no part. Components of any finite size count: vectors are scaled by a power
of two before they are squared. Equal scores go to smaller ids. Fewer candidates than asked: all. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash, text_bytes

EDGES = "id long, other long, sim double, fresh boolean"
STATE = "id long, bucket long, q binary, ids binary, sims binary, seen binary, front array<long>"


def _units(column) -> np.ndarray:
    """A binary column of 32-bit floats as a double matrix of unit vectors."""
    raw, _ = text_bytes(column)
    x = raw.view(np.float32).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(v: list[float], d: int) -> np.ndarray:
    """A vector filled up to d components, times the power of two that makes its largest one about 1."""
    x = np.zeros(d)
    x[: len(v)] = v
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _edges(a, b, s, fresh) -> pa.Table:
    return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64()), "fresh": pa.array(np.broadcast_to(fresh, len(a)), pa.bool_())})


def _best(ids: np.ndarray, other: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best distinct others of each id; of a pair that comes twice the older row."""
    order = np.lexsort((fresh, other, ids))
    i, o = ids[order], other[order]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (o[1:] != o[:-1])
    order = order[first]
    order = order[np.lexsort((other[order], -sim[order], ids[order]))]
    i = ids[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i, "left") < k]


def _compare(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a few vectors the `each` most similar others that beat its worst neighbour."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    c = min(each, len(ids) - 1)
    if c < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.float64)
    top = np.argpartition(-s, c - 1, axis=1)[:, :c]
    sim = np.take_along_axis(s, top, axis=1)
    ok = sim > worst[:, None]
    return np.repeat(ids, ok.sum(axis=1)), ids[top[ok]], sim[ok]


class Graph:
    """nodes: id, exact (array of double), small (unit vector of 32-bit floats), ids (the smallest ids of that vector); edges: id, other, sim, fresh."""

    def __init__(self, rows: DataFrame, *, id_col="vec_id", vec_col="embedding", k=32, rounds=3, keep_ids=6, seed=5):
        self.k, self.spark = k, rows.sparkSession
        x = F.col(vec_col)
        fine = x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")), F.lit(False))) & F.exists(x, lambda e: e != 0)
        vec = rows.filter(fine & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.transform(x, lambda e: e.cast("double"))).alias("exact"))
        # equal vectors share one node, named by its smallest id
        self.members = stash(vec)
        grouped = self._nodes(keep_ids)
        size = grouped.agg(F.max(F.size("exact")).alias("d"), F.count("*").alias("n")).first()
        self.d, self.n = size.d or 0, size.n
        self.nodes = stash(self._small(grouped))
        self.vectors = self.nodes.select(F.col("id").alias("other"), "small")
        self.edges = stash(self._start(seed))
        for r in range(rounds):
            self.edges = stash(self._descend(r))
            total = self.edges.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
            if total.fresh <= 1e-3 * total.n:  # the lists don't change any more
                break

    def _nodes(self, keep_ids: int) -> DataFrame:
        """A node for each distinct vector, with its smallest ids; salted first, for a vector that very many rows share."""
        order = Window.partitionBy("exact", "salt").orderBy("vec_id")
        part = self.members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep_ids)
        part = part.groupBy("exact").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        return part.select(F.element_at("ids", 1).alias("id"), "exact", F.slice("ids", 1, keep_ids).alias("ids"))

    def _small(self, grouped: DataFrame) -> DataFrame:
        d = self.d

        def run(batches):
            for b in batches:
                small = []
                for v in b.column("exact").to_pylist():
                    x = _scaled(v, d)
                    small.append((x / np.linalg.norm(x)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(small, pa.binary())], names=[*b.schema.names, "small"])

        return grouped.mapInArrow(run, "id long, exact array<double>, ids array<long>, small binary")

    def _buckets(self, rows_each: int = 4000) -> int:
        return max(1, -(-self.n // rows_each))

    def _start(self, seed: int, tables: int = 6, block: int = 1024) -> DataFrame:
        """Each vector's nearest in `tables` blocks: vectors on the same sides of random hyperplanes, dealt again where they exceed a block."""
        bits = max(0, int(np.log2(max(1, self.n / (block / 2)))))
        planes = np.random.default_rng(seed).standard_normal((self.d or 1, tables * max(1, bits)))
        k = self.k

        def code(batches):
            for b in batches:
                if b.num_rows:
                    bit = (_units(b.column("small")) @ planes > 0).reshape(b.num_rows, tables, -1)
                    c = bit.astype(np.int64) @ (1 << np.arange(bit.shape[2])) if bits else np.zeros((b.num_rows, tables), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("id")), tables)), pa.array(np.tile(np.arange(tables), b.num_rows)), pa.array(c.ravel())], names=["other", "t", "code"])

        coded = stash(self.nodes.select("id", "small").mapInArrow(code, "other long, t long, code long"))
        count = coded.groupBy("t", "code").agg(F.count("*").alias("n"))
        dealt = coded.join(count.hint("merge"), ["t", "code"]).select("other", "t", "code", F.pmod(F.xxhash64("other", "t"), F.ceil(F.col("n") / block)).alias("salt"))

        def near(table: pa.Table) -> pa.Table:
            ids = np.asarray(table.column("other")).astype(np.int64)
            return _edges(*_compare(ids, _units(table.column("small")), np.full(len(ids), -2.0), k), True)

        return self._merge(dealt.join(self.vectors.hint("merge"), "other").groupBy("t", "code", "salt").applyInArrow(near, EDGES))

    def _merge(self, offers: DataFrame) -> DataFrame:
        k = self.k

        def run(table: pa.Table) -> pa.Table:
            i, o, s, f = (np.asarray(table.column(c)) for c in ("id", "other", "sim", "fresh"))
            keep = _best(i, o, s, f, k)
            return _edges(i[keep], o[keep], s[keep], f[keep])

        return offers.groupBy(F.pmod(F.xxhash64("id"), F.lit(self._buckets())).alias("bucket")).applyInArrow(run, EDGES)

    def _descend(self, r: int, group: int = 96, each: int = 12) -> DataFrame:
        k, e = self.k, self.edges
        worst = e.groupBy(F.col("id").alias("other")).agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
        ways = e.select(F.col("id").alias("center"), "other").union(e.select(F.col("other").alias("center"), F.col("id").alias("other")))
        # a node with very many reverse neighbours is met in several groups of about `group`
        degree = ways.groupBy("center").agg(F.count("*").alias("n"))
        salt = F.pmod(F.xxhash64("other", F.lit(r)), F.ceil(F.col("n") / (2 * group)))
        dealt = ways.join(degree.hint("merge"), "center").dropDuplicates(["center", "other"])
        dealt = dealt.select("other", "center", salt.alias("salt"))
        # ids are dealt first, so the vectors travel once
        met = dealt.join(self.vectors.join(worst.hint("merge"), "other", "left").hint("merge"), "other")

        def run(table: pa.Table) -> pa.Table:
            center, salt, ids = (np.asarray(table.column(c)) for c in ("center", "salt", "other"))
            low = np.asarray(table.column("worst").fill_null(-2)).astype(np.float64)
            x = _units(table.column("small"))
            order = np.lexsort((ids, salt, center))
            cut = np.flatnonzero((np.diff(center[order]) != 0) | (np.diff(salt[order]) != 0)) + 1
            got = [_compare(ids[p], x[p], low[p], each) for p in np.split(order, cut)]
            i, o, s = (np.concatenate(c) for c in zip(*got, strict=True))
            keep = _best(i, o, s, np.ones(len(i), bool), k)
            return _edges(i[keep], o[keep], s[keep], True)

        bucket = F.pmod(F.xxhash64("center", "salt"), F.lit(self._buckets(2000))).alias("bucket")
        return self._merge(met.groupBy(bucket).applyInArrow(run, EDGES).unionByName(e.withColumn("fresh", F.lit(False))))

    def links(self) -> DataFrame:
        """id, links: neighbours and the k nearest reverse neighbours."""
        back = self.edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "sim")
        nearest = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
        back = back.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= self.k)
        return self.edges.select("id", "other").union(back.select("id", "other")).groupBy("id").agg(F.collect_set("other").alias("links"))

    def search(self, queries: DataFrame, *, beam=128, most_rounds=100, group=64) -> DataFrame:
        """id, other, score: for each node in `queries` (id) its best nodes, itself included, by the exact cosine.

        A round has two steps in groups of about `group` queries: the links of newly reached nodes, less those seen before, are looked
        up; their vectors are scored and the best `beam` of each query stay. A search that `most_rounds` rounds don't end raises an error.
        """
        links = stash(self.links().select(F.col("id").alias("node"), "links"))
        buckets = max(1, -(-queries.count() // group))
        asked = queries.join(self.nodes.hint("merge"), "id").select("id", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "small", "exact")
        asked = stash(asked)

        def begin(batches):
            for b in batches:
                ids = np.asarray(b.column("id")).astype(np.int64)
                own, one = pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([np.ones(1).tobytes()] * len(ids), pa.binary())
                front = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("bucket"), b.column("small"), own, one, own, front], names=["id", "bucket", "q", "ids", "sims", "seen", "front"])

        def unseen(state: pa.Table, got: pa.Table) -> pa.Table:
            out = []
            if got.num_rows:
                who, lists = np.asarray(got.column("id")), got.column("links").combine_chunks()
                flat, off = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
                pair = np.repeat(who, np.diff(off))
                order = np.argsort(pair, kind="stable")
                pair, flat = pair[order], flat[order]
                for i, seen in zip(np.asarray(state.column("id")).tolist(), state.column("seen").to_pylist(), strict=True):
                    a, b = np.searchsorted(pair, i, "left"), np.searchsorted(pair, i, "right")
                    if b > a:
                        new = np.setdiff1d(flat[a:b], np.frombuffer(seen, np.int64))
                        out.append((np.full(len(new), i), new))
            i, o = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            bucket = state.column("bucket")[0].as_py() if state.num_rows else 0
            return pa.table({"id": pa.array(i, pa.int64()), "bucket": pa.array(np.full(len(i), bucket), pa.int64()), "other": pa.array(o, pa.int64())})

        def advance(state: pa.Table, scored: pa.Table) -> pa.Table:
            who, other, x = np.asarray(scored.column("id")), np.asarray(scored.column("other")).astype(np.int64), _units(scored.column("small"))
            order = np.lexsort((other, who))
            who, other = who[order], other[order]
            cols: list[list] = [[], [], [], []]
            for row in state.select(["id", "q", "ids", "sims", "seen"]).to_pylist():
                ids, sims, seen = (np.frombuffer(row[c], k) for c, k in (("ids", np.int64), ("sims", np.float64), ("seen", np.int64)))
                a, b = np.searchsorted(who, row["id"], "left"), np.searchsorted(who, row["id"], "right")
                q = np.frombuffer(row["q"], np.float32).astype(np.float64)
                s = x[order[a:b]] @ (q / np.linalg.norm(q)) if b > a else np.zeros(0)
                all_ids, all_sims = np.concatenate([ids, other[a:b]]), np.concatenate([sims, s])
                keep = np.lexsort((all_ids, -all_sims))[:beam]
                for c, v in zip(cols, (all_ids[keep].tobytes(), all_sims[keep].tobytes(), np.concatenate([seen, other[a:b]]).tobytes(), all_ids[keep[keep >= len(ids)]].tolist()), strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            return pa.table(dict(zip(("id", "bucket", "q", "ids", "sims", "seen", "front"), [*(state.column(c) for c in ("id", "bucket", "q")), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], strict=True)))

        state = stash(asked.select("id", "bucket", "small").mapInArrow(begin, STATE))
        for _ in range(most_rounds):
            # new names for columns, as both sides of the cogroup come from `state`
            front = state.select(F.col("id").alias("who"), F.col("bucket").alias("deal"), F.explode("front").alias("node"))
            got = front.join(links.hint("merge"), "node").select(F.col("who").alias("id"), F.col("deal").alias("bucket"), "links")
            fresh = state.select("id", "bucket", "seen").groupBy("bucket").cogroup(got.groupBy("bucket")).applyInArrow(unseen, "id long, bucket long, other long")
            scored = fresh.join(self.vectors.hint("merge"), "other")
            state = stash(state.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(advance, STATE))
            if state.filter(F.size("front") > 0).isEmpty():
                break
        else:
            raise RuntimeError(f"a search goes on after {most_rounds} rounds")

        def reached(batches):
            for b in batches:
                parts = [np.frombuffer(v, np.int64) for v in b.column("ids").to_pylist()]
                n = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(c)), n), pa.int64()) for c in ("id", "bucket")] + [pa.array(np.concatenate(parts) if parts else [], pa.int64())], names=["id", "bucket", "other"])

        d = self.d

        def cosines(asks: pa.Table, pairs: pa.Table) -> pa.Table:
            q = dict(zip(asks.column("id").to_pylist(), [_scaled(v, d) for v in asks.column("exact").to_pylist()], strict=True))
            out = []
            for i, v in zip(pairs.column("id").to_pylist(), pairs.column("exact").to_pylist(), strict=True):
                a, b = q[i], _scaled(v, d)
                out.append(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))))
            return pa.table({"id": pairs.column("id"), "other": pairs.column("other"), "score": pa.array(out, pa.float64())})

        best = state.select("id", "bucket", "ids").mapInArrow(reached, "id long, bucket long, other long")
        pairs = best.join(self.nodes.select(F.col("id").alias("other"), "exact").hint("merge"), "other")
        return asked.select("id", "bucket", "exact").groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(cosines, "id long, other long, score double")


def nearest(rows: DataFrame, queries: Column, *, k=5, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row that `queries` (a condition on vec_id) names."""
    graph = Graph(rows, keep_ids=k + 1, **options)
    node_of = graph.members.filter(queries).join(graph.nodes.select("id", "exact").hint("merge"), "exact").select(F.col("vec_id").alias("query_id"), "id")
    node_of = stash(node_of)
    found = graph.search(node_of.select("id").distinct())
    ids = graph.nodes.select(F.col("id").alias("other"), F.explode("ids").alias("vec_id"))
    near = found.join(ids.hint("merge"), "other").select("id", "vec_id", "score")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)  # one of them may be the query itself
    each = node_of.join(near.hint("merge"), "id").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("r")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
