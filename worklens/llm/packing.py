"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

A document's ids (and the end id) are cut only if they exceed `capacity`; then the first piece takes what is left over
and the rest are full. Pieces are dealt by hash to nodes of about `node_items`; each node packs best-fit, longest
first, and emits the bins that are nearly full (`slack` tokens free at most). Its other bins go up as items to a parent of
`fan_in` nodes, which packs them best-fit among each other, and so on to one root, which emits all. A node sends up
the `carry` emptiest bins at most and emits the rest as they are, so no node's size grows with the input.

Cases: a null or empty text is its end id alone. Repeated rows are packed each. A null id is kept; its pieces are told
apart by their place only. No table, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, slices, stash

SPECIAL = "<|endoftext|>"
MEMO = 500_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Unsafe(Exception):
    """A part that can't be encoded by itself."""


class _Parts(dict):
    """Ids of a word with the space before it; made on first use, and kept while there is room."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unsafe
        out = self.ids(" " + word)
        if len(self) < MEMO:
            self[word] = out
        return out


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, the same as the tokenizer file gives for the whole text.

    The tokenizer splits before every single space between two visible characters, so what lies
    between such spaces can be encoded by itself, and the commonest parts' ids are kept. `ranks` names the
    same vocabulary as merge ranks (a .tiktoken file), which is faster for parts seen first; without it, or for
    texts with other white space beside their spaces, the tokenizer does it.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tok, short = Tokenizer.from_file(path), self.ids
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            short = lambda part: array("I", encode(part)).tobytes() if len(part) < 1000 else self.ids(part)
        self.first, self.parts = short, _Parts(short)

    def ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self.ids(text)
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return self.ids(text)
        try:
            return self.first(first) + b"".join(map(self.parts.__getitem__, words))
        except _Unsafe:
            return self.loose(first, words)

    def loose(self, hold: str, words: list[str]) -> bytes:
        """As encode(), with parts that begin or end with white space joined to their neighbours."""
        out = []
        for w in words:
            if w and not w[0].isspace() and not hold[-1].isspace():
                out.append(hold)
                hold = " " + w
            else:
                hold += " " + w
        out.append(hold)
        return b"".join([self.parts[p[1:]] if p[0] == " " and not p[-1].isspace() and not p[1:2].isspace() else self.ids(p) for p in out])


def pieces(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, id_col="doc_id", text_col="text", capacity=1024, end_id=2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = resident((tokenizer, ranks), lambda: Tokens(tokenizer, ranks))
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = tokens.encode(text) + end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(i, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (by number) of each bin: longest first, each into the fullest bin that has room, else into a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    free, bins = 0, []  # bit r of free: a bin with r free is open
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > s:
            room[r - s].append(b)
            free |= 1 << (r - s)
    return bins


MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
BIN = f"node long, level int, number long, used long, done boolean, members {MEMBER}"


def _pack_level(items: DataFrame, level: int, capacity: int, slack: int, carry: int, last: bool) -> DataFrame:
    """`items` (node, used, members) packed within each node."""

    def run(table: pa.Table) -> pa.Table:
        # one order whatever the order of arrival, so that a lost task packs the same bins again
        members = table.column("members").combine_chunks()
        flat, off = members.flatten(), np.asarray(members.offsets).astype(np.int64)
        ids, kinds = (np.asarray(flat.field(k).fill_null(-1)).astype(np.int64)[off[:-1] - off[0]] for k in (0, 1))
        used = np.asarray(table.column("used"))
        order = np.lexsort((kinds, ids, used))
        sizes = used[order].tolist()
        node = table.column("node")[0].as_py()
        bins = best_fit(sizes, capacity)
        total = np.array([sum(sizes[i] for i in b) for b in bins])
        done = np.ones(len(bins), bool) if last else total >= capacity - slack
        open_bins = np.flatnonzero(~done)
        if len(open_bins) > carry:
            done[open_bins[np.argsort(total[open_bins], kind="stable")[carry:]]] = True
        spread = order[np.concatenate([np.array(b, np.int64) for b in bins])]
        lengths = np.diff(off)
        rows = np.repeat(off[:-1][spread] - off[0], lengths[spread]) + np.arange(lengths[spread].sum()) - np.repeat(np.cumsum(lengths[spread]) - lengths[spread], lengths[spread])
        first = np.cumsum([0, *(len(b) for b in bins)])
        ends = np.concatenate([[0], np.cumsum(lengths[spread])])[first]
        return pa.table(
            {
                "node": pa.array(np.full(len(bins), node)),
                "level": pa.array(np.full(len(bins), level), pa.int32()),
                "number": pa.array(np.arange(len(bins))),
                "used": pa.array(total),
                "done": pa.array(done),
                "members": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(rows))),
            }
        )

    return items.groupBy("node").applyInArrow(run, BIN)


def pack(items: DataFrame, *, capacity=1024, slack=8, node_items=20_000, fan_in=8, carry=20_000) -> DataFrame:
    """`items` (the columns of pieces()) with sequence_id and offset."""
    items = stash(items)
    nodes = max(1, -(-items.count() // node_items))
    at = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(nodes))
    todo = items.select(at.alias("node"), F.col("length").alias("used"), F.array(F.struct(*items.columns)).alias("members"))
    level, packed = 0, []
    while True:
        bins = stash(_pack_level(todo, level, capacity, slack, carry, nodes == 1))
        packed.append(bins.filter("done"))
        if nodes == 1:
            break
        todo = bins.filter("not done").select(F.expr(f"node div {fan_in}").alias("node"), "used", "members")
        nodes, level = -(-nodes // fan_in), level + 1
    done = packed[0]
    for more in packed[1:]:
        done = done.unionByName(more)
    sequence = F.col("level").cast("long") * (1 << 56) + F.col("node") * (1 << 24) + F.col("number")
    ends = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.aggregate(F.slice("members", 1, i), F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("offset")))
    rows = done.select(sequence.alias("sequence_id"), F.explode(ends).alias("x"))
    return rows.select(*[F.col(f"x.m.{c}").alias(c) for c in items.columns], "sequence_id", "x.offset")


def default_tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), **default_tokenizer()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: where each piece of each document stands in the training sequences."""
    return pack(pieces(docs, **default_tokenizer()))
