"""Ranked lexical search by groups of documents with the same presence mask.

Every document is read once: its terms are counted, and those that an item asks for are kept as numbers beside its length. From these rows come the
statistics of the whole corpus. Then tasks search the rows where they lie, in blocks: a bitmap over a block's documents for each
term, and for each item the bitmaps of its terms, turned, give every document's mask of matched terms; documents with the same mask are a group. A mask's
maximum is the sum of its terms' greatest contributions in the block. Groups are evaluated by descending maximum, with exact scores, until the next maximum is under the
score of the k-th best document that the task has found for the item: no group left could change the result. The best of all
tasks meet in two steps, dealt by the document first.

Items are searched in groups whose distinct terms (`most_terms`) and terms with repeats over items are bounded, so what tasks hold of the items is bounded; more items take more passes.

Cases: null or empty texts have no terms and count in no statistic. Items that share an id are one item, with the terms of all; an item without an id is one too.
Items without terms, or whose terms weigh nothing, have no rows. Rows that repeat an id are documents of their own; a document without an id comes after others of its score. No documents, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8, after lower-casing: what is neither ASCII punctuation, blank nor control
PIECE = 1 << 20
SCALE = 1_000_000_000


def _counts(text: bytes | None) -> Counter:
    """How often each term occurs; long texts are taken by pieces that end between terms."""
    found: Counter = Counter()
    text, at = (text or b"").lower(), 0  # bytes.lower() changes A-Z alone
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            run = TERM.match(text, end)
            end = run.end() if run else end
        found.update(TERM.findall(text, at, end))
        at = end
    return found


def item_terms(items: DataFrame, *, id_col="item_id", text_col="text") -> DataFrame:
    """item, term (binary): the distinct terms of each item."""

    def split(batches):
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in _counts(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.binary())], names=["item", "term"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(split, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct()


def groups(terms: DataFrame, most_terms: int) -> Iterator[list[tuple]]:
    """(item, terms) in groups of at most `most_terms` terms with repeats over items; an item that has more is a group of its own."""
    sizes = terms.groupBy("item").agg(F.count("*").alias("n"), F.collect_list("term").alias("terms"))
    part, total = [], 0
    for r in sizes.sort("item").toLocalIterator():
        if part and total + r.n > most_terms:
            yield part
            part, total = [], 0
        part.append((r.item, sorted(map(bytes, r.terms))))
        total += r.n
    if part:
        yield part


def postings(docs: DataFrame, vocabulary: dict[bytes, int], *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n (terms with repeats), terms, tf (arrays: numbers of the vocabulary's terms that the document holds, and how often) of documents with terms."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = words.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, terms, tf = [], [], []
                for text in part.column(1):
                    found = _counts(text.as_buffer().to_pybytes() if text.is_valid else None)
                    hits = sorted((known[t], c) for t, c in found.items() if t in known)
                    n.append(found.total())
                    terms.append([h[0] for h in hits])
                    tf.append([h[1] for h in hits])
                whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])
                yield whole.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tf array<long>")


class Block:
    """Some documents: for each term a bitmap over them, who holds it and how much it adds there, and the most it adds."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int):
        self.size = len(n)
        doc = np.repeat(np.arange(len(n)), sizes)
        norm = 10 + (90 * n * total_docs) // total_terms
        adds = weights[terms] * ((SCALE * tf) // (1000 * tf + 8 * norm[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.adds, terms = doc[order], adds[order], terms[order]
        self.terms, first = np.unique(terms, return_index=True)
        self.first, self.last = first, np.append(first[1:], len(terms))
        self.most = np.maximum.reduceat(self.adds, first) if len(first) else np.zeros(0, np.int64)
        # terms that many documents hold keep a bitmap (64 times their number is more than the block's postings), others are set from their lists
        many = np.flatnonzero((self.last - first) * 64 >= self.size)
        self.place = np.full(len(first), -1)
        self.place[many] = np.arange(len(many))
        self.bitmaps = np.zeros((len(many), -(-self.size // 8)), np.uint8)
        for r in many.tolist():
            self._set(self.bitmaps[self.place[r]], r)

    def _set(self, bitmap: np.ndarray, row: int) -> None:
        held = self.doc[self.first[row] : self.last[row]]
        np.bitwise_or.at(bitmap, held >> 3, (1 << (held & 7)).astype(np.uint8))

    def _bitmaps(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.bitmaps.shape[1]), np.uint8)
        kept = self.place[rows] >= 0
        out[kept] = self.bitmaps[self.place[rows[kept]]]
        for i in np.flatnonzero(~kept).tolist():
            self._set(out[i], rows[i])
        return out

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the terms in `rows`: the distinct masks (mask by term), the documents that hold any ordered by mask, and where each mask's documents begin."""
        bitmaps = self._bitmaps(rows)
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), bitorder="little"))
        turned = np.packbits(np.unpackbits(bitmaps, axis=1, bitorder="little")[:, docs], axis=0).T
        wide = np.zeros((len(docs), -(-turned.shape[1] // 8) * 8), np.uint8)
        wide[:, : turned.shape[1]] = turned
        keys = wide.view(np.uint64)
        order = np.lexsort(keys.T)
        new = np.flatnonzero(np.any(np.diff(keys[order], axis=0, prepend=~keys[order][:1]) != 0, axis=1))
        return np.unpackbits(turned[order[new]], axis=1)[:, : len(rows)].astype(bool), docs[order], new

    def scores(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of `docs` (ascending) for the terms in `rows`."""
        out = np.zeros(len(docs), np.int64)
        for r in rows.tolist():
            held = self.doc[self.first[r] : self.last[r]]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            hit = held[at] == docs
            out[hit] += self.adds[self.first[r] : self.last[r]][at[hit]]
        return out

    def best(self, wanted: np.ndarray, k: int, floor: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may be among the k best at a score of `floor` (1 at least) or more."""
        at = np.searchsorted(self.terms, wanted)
        rows = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)] if len(self.terms) else at[:0]
        rows = rows[self.most[rows] > 0]
        none = np.zeros(0, np.int64)
        if not len(rows):
            return none, none
        masks, docs, first = self.masks(rows)
        maxima = masks.astype(np.int64) @ self.most[rows]
        line = np.argsort(-maxima, kind="stable")
        ends = np.append(first[1:], len(docs))
        got_docs, got, i = [none], [none], 0
        while i < len(line) and maxima[line[i]] >= floor:
            part, n = [], 0
            while i < len(line) and n < step and maxima[line[i]] >= floor:
                part.append(docs[first[line[i]] : ends[line[i]]])
                n += len(part[-1])
                i += 1
            some = np.sort(np.concatenate(part))
            scores = self.scores(rows, some)
            keep = scores >= floor
            got_docs.append(some[keep])
            got.append(scores[keep])
            every = np.concatenate(got)
            if len(every) >= k:
                floor = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
        got_docs, got = np.concatenate(got_docs), np.concatenate(got)
        return got_docs[got >= floor], got[got >= floor]


def _search(rows: DataFrame, items: list[tuple], weights: np.ndarray, total_docs: int, total_terms: int, k: int) -> DataFrame:
    """item (place in `items`), id, score: the k best documents of each task for each item."""
    shared = rows.sparkSession.sparkContext.broadcast(([np.array(t, np.int64) for _, t in items], weights))

    def search(batches):
        wanted, w = shared.value
        held: list[list[tuple]] = [[] for _ in wanted]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            block = Block(np.asarray(batch.column(1)), sizes, np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column(3).flatten()), w, total_docs, total_terms)
            for i, terms in enumerate(wanted):
                mine = held[i]
                docs, scores = block.best(terms, k, mine[-1][0] if len(mine) == k else 1)
                if len(docs):
                    mine += [(s, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                    mine.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    del mine[k:]
        out = [(i, d, s) for i, mine in enumerate(held) for s, d in mine]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.int64())], names=["item", "id", "score"])

    return rows.mapInArrow(search, f"item int, id {rows.schema['id'].dataType.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", k=10, most_terms=1 << 18) -> DataFrame:
    """item_id, rank, id, score: the `k` best documents of each item with a score above 0, equal scores by ascending id."""
    found = None
    terms = item_terms(items, id_col=item_id, text_col=item_text)
    kind = terms.schema["item"].dataType.simpleString()
    for part in groups(terms, most_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, mine in part for t in mine}))}
        rows = stash(postings(docs, vocabulary, id_col=id_col, text_col=text_col))
        total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * total.docs + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(vocabulary), np.int64)  # a term that no document holds adds nothing
        for r in df.select("term", weight.alias("w")).toLocalIterator():
            weights[r.term] = r.w
        asked = [(name, sorted(vocabulary[t] for t in mine)) for name, mine in part]
        best = _search(rows, asked, weights, total.docs, total.terms, k)
        order = [F.desc("score"), F.col("id").asc_nulls_last()]
        for by in (("item", F.pmod(F.xxhash64("id"), F.lit(64))), ("item",)):  # what many tasks found meets by documents first
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(asked)], f"item int, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")
        found = best if found is None else found.union(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, id {docs.schema[id_col].dataType.simpleString()}, score long")
    return found


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
i as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
c as (select r, doc_id, len(w)::bigint as n, w from d where len(w) > 0),
s as (select count(*) as total, sum(n)::bigint as terms from c),
p as (select r, term, count(*) as tf from (select r, unnest(w) as term from c) where term in (select term from i) group by all),
v as (select term, cast(floor(1000 * ln((2.0 * (select total from s) + 2)::double / (2 * count(*) + 1))) as bigint) as w from p group by term),
m as (select r, doc_id, 10 + (90 * n * total) // terms as m from c, s),
x as (select item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from i join p using (term) join v using (term) join m using (r) group by all),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from x join m using (r) where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""
