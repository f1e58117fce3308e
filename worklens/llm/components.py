"""Connected components by joins: every node gets the least label that links reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def least_labels(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label for `nodes` (node, label: a label of its own each) under `pairs` (a, b).

    Alternates two joins on the links alone: each node points to the least neighbour, and links are rewritten to
    join a node's larger neighbours with its least one (large star), then the smaller ones (small star). The number of rounds
    follows the logarithm of the longest chain; work follows the number of links. Nodes without links keep their
    label; null labels count as largest.
    """
    edges = stash(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(edges.filter("false")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least2.hint("merge"), "a").select(F.col("b").alias("x"), F.col("a"), "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = stash(small)
        moved = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not moved:
            break
    else:
        raise RuntimeError("links did not settle")
    # every edge now leads from a node to its component's least node
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = nodes.join(roots.hint("merge"), "node", "left").select("node", "label", F.coalesce("root", "node").alias("root"))
    least_label = named.groupBy("root").agg(F.min("label").alias("least"))
    return named.join(least_label.hint("merge"), "root").select("node", F.col("least").alias("label"))
