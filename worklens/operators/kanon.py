"""k-anonymous rollups: a bucket shows only if enough distinct people stand behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 4


def rollup(rows: DataFrame, *, dims: tuple[str, ...] = ("project", "outcome"), actor="actor", cost="est_cost_usd", floor=FLOOR, by: tuple[str, ...] = (), strict=False) -> DataFrame:
    """kind (dimension or total), bucket, session_count, contributors, total_cost, shown: all dimensions and the total in one pass.

    A bucket is shown at `floor` distinct actors; the total row is always there and tells whether the whole result may be shown. Totals are over
    all rows, hidden buckets included; `strict` takes them over rows whose buckets are all shown.
    """
    if strict:
        rows = visible(rows, dims=dims, actor=actor, floor=floor, by=by)
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("kind"), F.col(d).cast("string").alias("bucket")) for d in dims], F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("bucket"))))
    flat = rows.select(*by, F.col(actor).alias("_actor"), F.col(cost).alias("_cost"), keys.alias("_k")).select(*by, "_actor", "_cost", "_k.kind", "_k.bucket")
    # first by actor, so that a bucket that very many rows share is summed up before it meets
    each = flat.groupBy(*by, "kind", "bucket", "_actor").agg(F.count("*").alias("n"), F.sum("_cost").alias("c"))
    out = each.groupBy(*by, "kind", "bucket").agg(F.sum("n").alias("session_count"), F.count("_actor").alias("contributors"), F.round(F.coalesce(F.sum("c"), F.lit(0.0)), 6).alias("total_cost"))
    return out.withColumn("shown", F.col("contributors") >= floor)


def visible(rows: DataFrame, *, dims: tuple[str, ...] = ("project", "outcome"), actor="actor", floor=FLOOR, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows all of whose buckets have `floor` distinct actors."""
    for d in dims:
        shown = rows.groupBy(*by, d).agg(F.count_distinct(actor).alias("_n")).filter(F.col("_n") >= floor).select(*by, d)
        rows = rows.join(shown, [*by, d], "left_semi")
    return rows


def answerable(rows: DataFrame, *, actor="actor", floor=FLOOR, by: tuple[str, ...] = ()) -> DataFrame:
    """contributors and whether there are enough of them for any answer."""
    return rows.groupBy(*by).agg(F.count_distinct(actor).alias("contributors")).withColumn("insufficient", F.col("contributors") < floor)
