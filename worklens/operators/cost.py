"""What sessions cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import KINDS, cost, resolve_tier


def last_model(order="seq"):
    """The last model named in a group of turns."""
    named = F.col("model").isNotNull() & (F.col("model") != "")
    return F.max_by("model", F.when(named, F.col(order)))


def session_cost(turns: DataFrame, *, by="session_id", order="seq") -> DataFrame:
    """Token sums, model, tier and usd of each session: all tokens at the last named model's rate."""
    sums = turns.groupBy(by).agg(*[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in KINDS], last_model(order).alias("model"))
    return sums.withColumn("tier", resolve_tier(F.col("model"))).withColumn("usd", cost(F.col("model"), [F.col(k) for k in KINDS]))


def cost_table(sessions: DataFrame, costs: DataFrame, *, newest: int | None = None) -> DataFrame:
    """Cost of each session, newest first, with the total over all rows shown; `newest` keeps so many rows."""
    rows = sessions.select("id", "project", "started_at").join(costs.withColumnRenamed("session_id", "id").hint("merge"), "id", "left")
    if newest is not None:
        rows = rows.orderBy(F.desc("started_at"), "id").limit(newest)
    rows = rows.withColumn("usd", F.coalesce("usd", F.lit(0.0)))
    total = rows.agg(F.round(F.sum("usd"), 6).alias("total_usd"))
    return rows.withColumn("total_usd", total.scalar())
