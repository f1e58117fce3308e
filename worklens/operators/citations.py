"""Citations in narratives: `[id, id]`, by whole id or unique prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pieces() -> Column:
    """The distinct parts of all bracketed lists of a text, as an array."""
    lists = F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(lists, lambda x: F.split(x, r"[,\s]+"))), lambda p: p != ""))


def cited_pieces(narratives: DataFrame) -> DataFrame:
    """query_id, piece: the distinct parts of all bracketed lists."""
    return narratives.select("query_id", F.explode(_pieces()).alias("piece")).distinct()


def resolve(narratives: DataFrame, visible: DataFrame) -> DataFrame:
    """query_id, id, rank: what a narrative cites of its visible rows (query_id, id, rank). A piece that is a prefix of several ids grounds none of them, even
    if it is one of them. A query's pieces are one row, which the visible rows pass: those are sent once, by their query, and only what begins with a piece goes on."""
    pieces = narratives.select("query_id", _pieces().alias("p")).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("pieces"))
    met = visible.select("query_id", "id", "rank").join(pieces.hint("shuffle_hash"), "query_id")
    hits = met.select("query_id", "id", "rank", F.explode(F.filter("pieces", lambda p: F.col("id").startswith(p))).alias("piece"))
    # the groups are sorted for, which a number that leads the key makes quick
    single = hits.groupBy(F.xxhash64("query_id"), "query_id", "piece").agg(F.min("id").alias("id"), F.max("id").alias("_last"), F.min("rank").alias("rank")).filter("id = _last")
    return single.select("query_id", "id", "rank").distinct()


def grounded(narratives: DataFrame, visible: DataFrame) -> DataFrame:
    """query_id, citations (in visible order), grounded."""
    found = resolve(narratives, visible).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"))
    out = narratives.select("query_id").distinct().join(found.hint("merge"), "query_id", "left")
    return out.select("query_id", F.coalesce(F.col("c.id"), F.array().cast("array<string>")).alias("citations"), F.col("c").isNotNull().alias("grounded"))


def answers(rollup: DataFrame, narratives: DataFrame, visible: DataFrame) -> DataFrame:
    """query_id, text, citations, insufficient: a narrative counts only if its query's rollup (query_id, insufficient) is sufficient and it cites something."""
    g = grounded(narratives, visible)
    joined = rollup.select("query_id", F.col("insufficient").alias("_few")).join(narratives, "query_id", "left").join(g.hint("merge"), "query_id", "left")
    bad = F.col("_few") | ~F.coalesce("grounded", F.lit(False))
    return joined.select("query_id", F.when(~bad, F.col("text")).alias("text"), F.when(bad, F.array().cast("array<string>")).otherwise(F.col("citations")).alias("citations"), bad.alias("insufficient"))


def brief(visible: DataFrame) -> DataFrame:
    """query_id, brief: the visible rows as JSON, for whoever writes the narrative."""
    item = F.struct("rank", F.struct("id", "project", "task_intent", "outcome").alias("row"))
    return visible.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c")).select("query_id", F.to_json(F.col("c.row")).alias("brief"))
