"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of its word
shingles. Two fingerprints link at `radius` (3) or fewer differing bits. Distinct fingerprints are indexed in two
32-bit segments; of 3 differing bits at most 1 lies in one of the segments, so each fingerprint
looks up the ball of radius 1 (33 keys) in each segment's tables, one for each half, and whole distances are verified. Only
distinct fingerprints are linked, never copies; a bucket of the index returns a spanning forest of its links, not all
pairs. Components are the least id that links reach. Wider fingerprints (`words` of 64 bits) and more segments find
texts further apart; wide_plan() chooses them for a similarity. The pipeline's stage takes them for candidates only and compares the shingle sets.

Cases: null or empty texts have fingerprint 0 and link like any other (in the pipeline's stage too: one of them stays);
repeated rows share their fingerprint; a row with a null id gets the component of its fingerprint, but names none (null, if no row with
an id has it). Extra columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash, vacate
from .components import least_labels

def text_fingerprint(hashes: list[int]) -> int:
    """Majority of each bit over the hashes; a plain form for single texts and tests."""
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of `size` words (white space is ASCII's); of all words, if fewer."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone; split() takes space and \t to \r
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(b" ".join(words), seed)]
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    return [h(joined[a:b], seed) for a, b in zip([0, *ends], [e - 1 for e in ends[size - 1 :]], strict=False)]


def _majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """`words` 64-bit words of the fingerprint; the first is that of the hashes as they are, the others of remixed hashes."""
    out, n = np.zeros(words, np.uint64), len(hashes)
    for j in range(words):
        h = hashes
        if j:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        total = np.zeros(64, np.int64)
        for a in range(0, n, 1 << 16):
            total += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, *, text_col="text", size=3, words=1, out="fp") -> DataFrame:
    """`docs` without its text, with the fingerprint as 8 * `words` bytes, most significant first."""
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in slices(batches, text_col):
            fps = [_majority(np.array(shingle_hashes(t, size), np.uint64), words).astype(">u8").tobytes() for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps, pa.binary())], names=[*keep, out])

    return docs.mapInArrow(run, docs.select(*keep).schema.add(out, "binary"))


def _segments(fps: np.ndarray, width: int, count: int) -> np.ndarray:
    """`count` segments of `width` (at most 32) bits of each fingerprint, given as bits in the order of significance."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)[:, : width * count].reshape(len(fps), count, width)
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def _segment(fps: np.ndarray, width: int, j: int) -> np.ndarray:
    """Segment j alone."""
    first, last = j * width, (j + 1) * width
    held = fps.view(np.uint8).reshape(len(fps), -1)[:, first // 8 : -(-last // 8)]
    bits = np.unpackbits(held, axis=1)[:, first % 8 : first % 8 + width]
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of n nodes to the least node of its component: as much as the pairs (a, b) say, without their number."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[label], label):
            break
        label = new[label]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _within(fps: np.ndarray, one: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(fps ^ one).sum(axis=-1) <= radius


def _crowd(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links among many fingerprints that share a key: each newly reached one is compared with those not reached yet."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _within(fps[left], fps[x], radius)
            a += [x] * int(near.sum())
            b += (found := left[near].tolist())
            todo += found
            left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


CROWD, BLOCK = 4_000_000, 250_000


def _link(own: np.ndarray, fps: np.ndarray, key: np.ndarray, width: int, radius: int, flips: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links in one bucket. `own`: rows that are the table, and look up their ball of radius 1 in the key's `width` bits, or what `flips` names of it: bits, and None for the
    key itself. Other rows look up their key as it is."""
    table = np.flatnonzero(own)
    order = table[np.argsort(key[table], kind="stable")]
    sorted_keys, a, b = key[order], [], []
    crowded = np.zeros(len(fps), bool)
    values, at, n = np.unique(sorted_keys, return_index=True, return_counts=True)
    for i in np.flatnonzero(n.astype(np.int64) ** 2 > CROWD) if flips is None or None in flips else []:
        rows = order[at[i] : at[i] + n[i]]
        x, y = _crowd(fps[rows], radius)
        a.append(rows[x])
        b.append(rows[y])
        crowded[rows] = True
    for flip in [None, *range(width)] if flips is None else flips:
        rows = np.arange(len(fps)) if flip is None else table[key[table] >> flip & 1 == 0]  # of two keys that differ in a bit, one asks
        look = key[rows] if flip is None else key[rows] ^ (1 << flip)
        lo, hi = np.searchsorted(sorted_keys, look, "left"), np.searchsorted(sorted_keys, look, "right")
        if flip is None:
            hi = np.where(crowded[rows], lo, hi)
        some = hi > lo
        rows, lo, n_hits = rows[some], lo[some], (hi - lo)[some]
        cuts = np.flatnonzero(np.diff(np.cumsum(n_hits) // BLOCK, prepend=0))
        for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if e > s:
                left = np.repeat(rows[s:e], n_hits[s:e])
                first = np.repeat(lo[s:e] - np.concatenate([[0], np.cumsum(n_hits[s:e])[:-1]]), n_hits[s:e])
                right = order[first + np.arange(len(left))]
                ok = left != right
                left, right = left[ok], right[ok]
                ok = _within(fps[left], fps[right], radius)
                x, y = _forest(left[ok], right[ok], len(fps)) if ok.sum() > len(fps) else (left[ok], right[ok])
                a.append(x)
                b.append(y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(a), np.concatenate(b), len(fps))


ROUND = 2_048  # bytes that a fingerprint's copies may take on the disk at once


def links(fps: DataFrame, *, n: int, words: int, width: int, count: int, radius: int) -> DataFrame:
    """Links (a, b) between ids, enough to connect all that lie within `radius` bits and, in one of `count` segments of `width` bits, within 1 bit.

    `fps`: id (long), fp (distinct). Of segments within 1 bit one half at least is equal, so a fingerprint goes to two buckets for each segment, whatever n: those of its
    first half, where the other half's ball is looked up, and of its second. A bucket holds the first `top` bits of a half, about 40,000 rows at any
    size. Only a spanning forest leaves a bucket. Segments are dealt in rounds, so that the copies of a fingerprint never take much more than ROUND bytes.
    """
    low = width // 2
    halves = ((low, width - low), (0, low))  # where the half that must be equal begins, and how many bits it has
    top = min(low, max(1, int(np.ceil(np.log2(max(1, n) / 40_000)))))

    def link(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        raw = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64).reshape(len(ids), words)
        j, side = divmod(int(table.column("bucket")[0].as_py()) >> top, 2)
        flips = [*range(low, width)] if side else [None, *range(low)]
        a, b = _link(np.ones(len(ids), bool), raw, _segment(raw, width, j), width, radius, flips)
        return pa.table({"a": ids[a], "b": ids[b]})

    def dealt(first: int, last: int) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.asarray(batch.column("id")).astype(np.int64)
                raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(len(ids), words)
                out: list[tuple[int, bytes, bytes]] = []
                for j in range(first, last):
                    seg = _segment(raw, width, j)
                    for side, (shift, bits) in enumerate(halves):
                        bucket = (2 * j + side << top) + (seg >> shift + bits - top & (1 << top) - 1)
                        order = np.argsort(bucket, kind="stable")
                        cut = np.flatnonzero(np.diff(bucket[order])) + 1
                        out += [(int(bucket[rows[0]]), ids[rows].tobytes(), raw[rows].tobytes()) for rows in np.split(order, cut)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "ids", "fps"])

        parts = fps.select("id", "fp").mapInArrow(deal, "bucket long, ids binary, fps binary")
        return parts.groupBy("bucket").applyInArrow(link, "a long, b long").distinct()

    rounds = max(1, -(-count * 2 * 8 * (1 + words) // ROUND))
    if rounds == 1:
        return dealt(0, count)
    size = -(-count // rounds)
    parts = [stash(dealt(j, min(count, j + size))) for j in range(0, count, size)]
    return reduce(DataFrame.union, parts)


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", size=3, radius=3, words=1, width=32, count=2) -> DataFrame:
    """id, fp and component_id (the least id of all that links reach, itself included) for each row. Ids are integers."""
    if words * 64 < width * count:
        raise ValueError("the segments need more bits than a fingerprint has")
    marked = stash(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), size=size, words=words))
    distinct = stash(marked.groupBy("fp").agg(F.min("id").alias("id")))
    known = distinct.filter("id is not null")
    pairs = links(known, n=known.count(), words=words, width=width, count=count, radius=radius)
    label = least_labels(known.select(F.col("id").alias("node"), F.col("id").alias("label")), pairs)
    label = stash(distinct.join(label.hint("merge"), distinct.id == label.node, "left").select("fp", F.col("label").alias("component_id")))
    # an inner join, so that Spark can split a fingerprint that very many rows share
    return marked.join(label.hint("merge"), "fp")


def wide_plan(n: int, similarity: float = 0.8, found: float = 0.99) -> dict:
    """Fingerprint and segments that make texts candidates whose shingle sets have at least this Jaccard similarity, among n texts.

    Two such texts differ in each bit with probability arccos(2J / (1 + J)) / pi. Segments are as long as log2(n) bits, so a key holds few
    texts by chance, and as many as it takes for one of them to differ in 1 bit at most in `found` of the cases, at every n. The
    distance allowed is that share of the bits and three standard deviations more; unrelated texts differ in half.
    """
    e = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    width = int(np.clip(np.ceil(np.log2(max(2, n))), 14, 30))
    one = (1 - e) ** width + width * e * (1 - e) ** (width - 1)
    count = int(np.ceil(np.log(1 - found) / np.log(1 - one)))
    words = max(4, -(-width * count // 64))
    bits = 64 * words
    return {"words": words, "width": width, "count": count, "radius": int(np.ceil(bits * e + 3 * np.sqrt(bits * e * (1 - e))))}


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of shingle_hashes(), ascending."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def _marks(docs: DataFrame, size: int, words: int) -> DataFrame:
    """id, at, fp (of the set, so that repeated shingles count once) and key (128 bits of the set) of `docs` (id, at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in slices(batches, "text"):
            fps, keys = [], []
            for t in batch.column("text").to_pylist():
                found = shingle_set(t, size)
                fps.append(_majority(found, words).astype(">u8").tobytes())
                keys.append(_set_key(found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), pa.array(fps, pa.binary()), pa.array(keys, pa.binary())], names=["id", "at", "fp", "key"])

    return docs.mapInArrow(run, "id long, at long, fp binary, key binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """`docs` (id, key, coarse, text) with the set instead of the text; rows whose text has another key are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in slices(batches, "text"):
            keys, at, out = batch.column("key").to_pylist(), [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                found = shingle_set(t, size)
                if _set_key(found) == keys[i]:
                    at.append(i)
                    out.append(found.tobytes())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "key", "coarse")), pa.array(out, pa.binary())], names=["id", "key", "coarse", "hashes"])

    return docs.mapInArrow(run, "id long, key binary, coarse long, hashes binary")


def _verify(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all pairs whose sets have at least this Jaccard similarity."""
    none = np.zeros(0, np.int64)
    if not a or not b:
        return none, none
    order = np.argsort([len(y) for y in b], kind="stable")
    size = np.array([len(b[i]) for i in order])
    values, place = np.unique(np.concatenate([b[i] for i in order]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark, left, right = np.zeros(len(values) + 1, bool), [], []
    for i, x in enumerate(a):
        # a size further off than the similarity allows can't be met
        lo = int(np.searchsorted(size, len(x) * similarity * (1 - 1e-9), "left"))
        hi = int(np.searchsorted(size, len(x) / similarity * (1 + 1e-9), "right"))
        if not len(x) or hi <= lo:
            continue
        at = np.searchsorted(values, x)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == x)]
        mark[at] = True
        both = np.add.reduceat(mark[place[start[lo] : start[hi]]], start[lo:hi] - start[lo], dtype=np.int64)
        mark[at] = False
        hit = lo + np.flatnonzero(both / (len(x) + size[lo:hi] - both) >= similarity)
        left.append(np.full(len(hit), i))
        right.append(order[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


BLOCK_SETS, BLOCK_HASHES = 1024, 500_000


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between ids, enough to connect all members of a coarse component whose sets have at least this similarity.

    `sets`: id, key, coarse, hashes (ascending distinct hashes), a row for each key. Each set is held against that of the component's least id first.
    Those that link to it are connected by this, so only pairs with a set that doesn't are left; a linked one too near the first for any
    of these (distances obey the triangle inequality) is done. The rest of a component is dealt to blocks by hash, and
    each pair of blocks is one group, of a bounded number of sets and hashes (one longer set stays whole).
    """
    first = sets.groupBy("coarse").agg(F.min(F.struct("id", "key")).alias("f"))
    first = first.select(F.col("f.key").alias("key"), F.col("f.id").alias("first")).join(sets.select("key", "coarse", F.col("hashes").alias("with")).hint("merge"), "key")
    first = first.select("coarse", F.col("key").alias("first_key"), "first", "with")

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(c).to_pylist()] for c in ("hashes", "with"))
            both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)]
            jaccard = [n / max(1, len(p) + len(q) - n) for n, p, q in zip(both, x, y, strict=True)]
            size = pa.array([len(p) for p in x], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "key", "coarse", "hashes", "first")), size, pa.array(jaccard, pa.float64())], names=["id", "key", "coarse", "hashes", "first", "size", "jaccard"])

    met = sets.join(first.hint("merge"), "coarse").filter("key <> first_key").select("id", "key", "coarse", "hashes", "first", "with")
    met = stash(met.mapInArrow(against, "id long, key binary, coarse long, hashes binary, first long, size long, jaccard double"))
    near = F.col("jaccard") >= similarity
    direct = met.filter(near).select(F.col("id").alias("a"), F.col("first").alias("b"))

    far = met.filter(~near).groupBy("coarse").agg(F.max("jaccard").alias("nearest"))
    # 1 - jaccard is a metric: a link to a set at `nearest` needs a distance from the first of at least (1 - nearest) - (1 - similarity)
    rest = met.join(far.hint("merge"), "coarse").filter(~near | (1 - F.col("jaccard") >= similarity - F.col("nearest") - 1e-9))
    rest = rest.select("id", "key", "coarse", "hashes", "size", (~near).alias("far"))
    count = rest.groupBy("coarse").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("total") / BLOCK_HASHES))
    dealt = rest.join(count.filter("n > 1").hint("merge"), "coarse").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("coarse", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "hashes", "far")

    def compare(table: pa.Table) -> pa.Table:
        ids, own, far = (np.asarray(table.column(c)) for c in ("id", "own", "far"))
        sets = [np.frombuffer(v, np.uint64) for v in table.column("hashes").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        # far sets of the one block with all of the other, then far sets of the other with the rest of the one
        turns = [(far, np.ones(len(ids), bool))] if i == j else [(far & (own == i), own == j), (far & (own == j), ~far & (own == i))]
        a, b = [], []
        for p, q in turns:
            p, q = np.flatnonzero(p), np.flatnonzero(q)
            for s in range(0, len(p), 256):
                x, y = _verify([sets[k] for k in p[s : s + 256]], [sets[k] for k in q], similarity)
                x, y = _forest(p[s : s + 256][x], q[y], len(ids))
                a.append(x)
                b.append(y)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        a, b = _forest(a, b, len(ids))
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return direct.unionByName(dealt.groupBy("coarse", "i", "j").applyInArrow(compare, "a long, b long"))


def similar_documents(docs: DataFrame, *, similarity=0.8, size=5) -> DataFrame:
    """id and component_id (the least id of all that links reach) for each row of `docs` (id, text). Texts link if the Jaccard similarity of their
    shingle sets (64-bit hashes) is at least `similarity`: near fingerprints only make candidates, whose sets are compared."""
    docs = docs.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("at"), "text")  # `at` parts rows that repeat an id
    plan = wide_plan(docs.count(), similarity)
    marked = stash(_marks(docs, size, plan["words"]))
    units = stash(marked.filter("id is not null").groupBy("key", "fp").agg(F.min(F.struct("id", "at")).alias("m")).select("key", "fp", "m.id", "m.at"))
    known = stash(units.groupBy("fp").agg(F.min("id").alias("id")))
    pairs = links(known, n=known.count(), **plan)
    label = least_labels(known.select(F.col("id").alias("node"), F.col("id").alias("label")).distinct(), pairs)
    label = known.join(label.hint("merge"), known.id == label.node).select("fp", F.col("label").alias("coarse"))
    coarse = stash(units.join(label.hint("merge"), "fp").select("id", "at", "key", "coarse"))
    several = coarse.groupBy("coarse").agg(F.count("*").alias("n")).filter("n > 1").select("coarse")
    asked = stash(coarse.join(several.hint("merge"), "coarse"))
    sets = stash(_sets(docs.join(asked.hint("merge"), ["id", "at"]).select("id", "key", "coarse", "text"), size).dropDuplicates(["key"]))
    label = least_labels(coarse.select(F.col("id").alias("node"), F.col("id").alias("label")).distinct(), verified_links(sets, similarity))
    label = units.join(label.hint("merge"), units.id == label.node).select("key", F.col("label").alias("component_id"))
    return marked.filter("id is not null").select("id", "key").join(label.hint("merge"), "key").select("id", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float = 0.8) -> DataFrame:
    """Pipeline stage: of texts that share five-word shingles at `similarity` or more, the document with the least id of each component stays."""
    found = similar_documents(docs.select(F.col("doc_id").alias("id"), "text"), similarity=similarity)
    gone = found.filter("id <> component_id").select(F.col("id").alias("_wl_id")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_wl_id"], "left_anti").select(*docs.columns)
