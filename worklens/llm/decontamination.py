"""Benchmark decontamination by a prefix-filtered set join.

The windows of benchmark items (runs of `window` words, or all words of a shorter item) are sets of shingles, up to three words long. Documents count how often
each of these shingles occurs, and a window's shingles are ordered from rare to common. An occurrence holds all of them, so the necessary prefix
is one shingle, the rarest: documents meet a window by that shingle alone, and a window with a shingle that no document has meets none. The
place of the shingle in the document and in the window gives where the window would begin; it has to lie within the document (positional and length bound), and the words there
are compared with the window's own. Shingles are met by 64-bit hashes, which the comparison of words makes harmless.

Documents are read in three passes (words, shingle counts, windows) and their words never move: what is shuffled are counts of benchmark shingles, occurrences, and
a row for each document. Windows are broadcast in groups of at most `most_bytes`, measured before; a larger benchmark takes more passes. All of it is DataFrame functions.

Cases: null or empty texts have no words and no windows. Rows that repeat an id are documents of their own; so are rows without an id. Items that
share an id are one item; windows of items without an id make hits but no item. Without documents no rows; without items nobody is hit. Extra columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased. (Splitting takes a third of the time that extracting takes.)"""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def _key(w: str, at: Column, size: int) -> Column:
    """The hash of the shingle of `size` words of `w` from place `at` on."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(w), at + i) for i in range(size)])


def windows(items: DataFrame, *, id_col="item_id", text_col="text", window=10) -> DataFrame:
    """item (string), passage: every item's windows, their words joined by spaces."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window, F.lit(0)) + 1)
    return rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("passage")).distinct()


def _groups(rows: DataFrame, by: str, size: Column, most_bytes: int) -> list[DataFrame]:
    """`rows`, dealt by `by` to as many tables as it takes for each to have about `most_bytes` of `size`."""
    n = max(1, -(-(rows.agg(F.sum(size).alias("n")).first().n or 0) // most_bytes))
    return [rows if n == 1 else rows.filter(F.pmod(F.xxhash64(by, F.lit("group")), F.lit(n)) == i) for i in range(n)]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window=10, most_bytes=32 << 20) -> DataFrame:
    """id, n_words, n_hit (words inside an occurrence of a window), items (array of string, sorted: those with an occurrence) of each document."""
    named = stash(windows(items, id_col=item_id, text_col=item_text, window=window))
    passages = named.select("passage").distinct().select("passage", F.split("passage", " ").alias("p")).withColumn("size", F.size("p"))
    parts = [passages.filter(F.least("size", F.lit(SHINGLE)) == k).select("passage", "p", "size", F.lit(k).alias("k"), F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("off")).withColumn("key", _key("p", F.col("off"), k)) for k in range(1, SHINGLE + 1)]
    shingles = stash(_all(parts))
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())  # at most 1, 2, 3

    texts = docs.select(F.col(id_col).alias("id"), F.sha2(F.concat_ws(" ", F.col(id_col).cast("string"), F.lit(""), F.col(text_col)), 256).alias("doc"), words(F.col(text_col)).alias("w"))

    def places(*columns: str) -> DataFrame:
        """A row for each place of a document and size of shingle: columns, at, key. (The outer form keeps Spark from finding the words twice.)"""
        rows = texts.select(*columns, "w", F.posexplode_outer("w").alias("at", "word"))
        keys = [F.when(F.col("at") + k <= F.size("w"), _key("w", F.col("at"), k)) for k in sizes]
        return rows.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))

    if sizes:
        # from rare to common: how often documents hold the shingles of windows
        asked = stash(shingles.select("key").distinct())
        counts = _all([places().select("key").join(F.broadcast(g), "key").groupBy("key").agg(F.count("*").alias("n")) for g in _groups(asked, "key", F.lit(64), most_bytes)])
        ranked = shingles.join(stash(counts).hint("merge"), "key", "left")
        first = ranked.groupBy("passage", "size").agg(F.min(F.struct("n", "off", "key")).alias("first"), F.bool_and(F.col("n").isNotNull()).alias("met"))
        prefix = stash(first.filter("met").select("passage", "size", "first.off", "first.key"))
        hits = []
        for g in _groups(prefix, "passage", F.octet_length("passage") * 2 + 128, most_bytes):
            g = g.select("key", "off", "size", "passage", F.split("passage", " ").alias("p"))
            met = places("doc").join(F.broadcast(g), "key").withColumn("begin", F.col("at") - F.col("off"))
            inside = (F.col("begin") >= 0) & (F.col("begin") + F.col("size") <= F.size("w"))
            same = F.when(inside, F.slice("w", F.greatest(F.col("begin"), F.lit(0)) + 1, F.col("size")) == F.col("p"))
            hits.append(met.filter(same).select("doc", "begin", (F.col("begin") + F.col("size")).alias("end"), "passage"))
        found = stash(_all(hits))
    else:
        found = docs.sparkSession.createDataFrame([], "doc string, begin int, end int, passage string")

    spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    add = lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(x["end"] - F.greatest(s["upto"], x["begin"]), F.lit(0))).alias("n"))
    hit = found.groupBy("doc").agg(F.aggregate(spans, start, add)["n"].alias("n_hit"))
    # which items: distinct passages of a document first, so that a passage's items count once
    owned = _groups(named.filter("item is not null"), "passage", F.octet_length("passage") + F.octet_length("item") + 96, most_bytes)
    pairs = _all([found.select("doc", "passage").distinct().join(F.broadcast(g), "passage").select("doc", "item") for g in owned])
    listed = pairs.distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    every = texts.select("id", "doc", F.size("w").cast("long").alias("n_words")).groupBy("doc", "id", "n_words").agg(F.count("*").alias("copies"))
    rows = every.join(hit.hint("merge"), "doc", "left").join(listed.hint("merge"), "doc", "left")
    rows = rows.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    return rows.drop("_")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


WORD = BETWEEN.replace("[", "[^", 1)
OP12_SQL = rf"""
with d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') as w from documents
), i as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') as w from benchmark
), s as (select item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as a from i where len(w) > 0
), p as (select distinct item, least(len(w), 10) as k, array_to_string(list_slice(w, a + 1, a + 10), ' ') as t from s
), k as (select distinct k from p
), a as (select r, k, w, unnest(range(0, len(w) - k + 1)) as a from d, k where len(w) >= k
), h as (select r, a, x.k, item from (select r, k, a, array_to_string(list_slice(w, a + 1, a + k), ' ') as t from a) x join p on p.k = x.k and p.t = x.t
), n as (select r, count(distinct q) as n_hit from (select r, unnest(range(a, a + k)) as q from h) group by r
), m as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h where item is not null) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join m using (r)
"""
