"""Turns into sessions: a pause over `gap` or a length over `cap` begins a new one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP, CAP = 30 * 60, 6 * 3600


def fold_cap(micros: np.ndarray, cap: int) -> np.ndarray:
    """Which turns of one gap segment begin a new session because the session's first time is over `cap` away."""
    out, anchor = np.zeros(len(micros), bool), None
    for i, t in enumerate(micros.tolist()):
        if t is None or t != t:
            continue
        if anchor is None:
            anchor = t
        elif t - anchor > cap:
            out[i], anchor = True, t
    return out


def split_turns(turns: DataFrame, *, base="transcript", order="seq", time="timestamp", gap=GAP, cap=CAP) -> DataFrame:
    """`turns` with `segment` (from 1), `session_id`, `new_seq` (from 0 in the session) and `opened_by` (null, gap or cap).

    Times are taken in the order of `order`; a null time takes the last one seen. Windows find the gaps; only gap segments
    that outlast the cap go through the sequential fold.
    """
    line = Window.partitionBy(base).orderBy(order)
    at = F.unix_micros(F.last(time, ignorenulls=True).over(line))
    rows = turns.withColumn("_at", at)
    rows = rows.withColumn("_gap", F.coalesce(F.col("_at") - F.lag("_at").over(line) > gap * 1_000_000, F.lit(False)))
    rows = rows.withColumn("_part", F.sum(F.col("_gap").cast("long")).over(line))
    part = Window.partitionBy(base, "_part")
    over = F.max("_at").over(part) - F.first("_at", ignorenulls=True).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_long", F.coalesce(over > cap * 1_000_000, F.lit(False)))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("o")
        times = table.column("_at").to_pandas().to_numpy()
        breaks = fold_cap(times, cap * 1_000_000)
        return table.select(["b", "o"]).filter(pa.array(breaks))

    kind = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    long = rows.filter("_long").select(F.col(base).alias("b"), F.col(order).alias("o"), "_at", "_part")
    caps = long.groupBy("b", "_part").applyInArrow(fold, f"b {kind[base]}, o {kind[order]}").withColumn("_cap", F.lit(True))
    rows = rows.join(caps.hint("merge"), (rows[base] == caps["b"]) & (rows[order] == caps["o"]), "left").drop("b", "o")
    rows = rows.withColumn("opened_by", F.when(F.col("_gap"), "gap").when(F.col("_cap"), "cap"))
    rows = rows.withColumn("segment", (F.sum(F.col("opened_by").isNotNull().cast("long")).over(line) + 1).cast("long"))
    rows = rows.withColumn("session_id", F.when(F.col("segment") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("."), "segment")))
    rows = rows.withColumn("new_seq", (F.row_number().over(Window.partitionBy(base, "segment").orderBy(order)) - 1).cast("long"))
    return rows.drop("_at", "_gap", "_part", "_long", "_cap")


def sessions(split: DataFrame, *, base="transcript", order="seq", time="timestamp", fallback=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each session of split_turns(): id, times, turn_count, ended_reason, resumed_from. `keep`: columns constant in a
    transcript. Without any time, started_at is `fallback` (a column of the turns), ended_at null."""
    has = F.col(time).isNotNull()
    first = F.min_by(time, F.when(has, F.col(order)))
    rows = split.groupBy(base, "segment", "session_id").agg(
        F.coalesce(first, F.min(fallback)).alias("started_at") if fallback else first.alias("started_at"),
        F.max_by(time, F.when(has, F.col(order))).alias("ended_at"),
        F.count("*").alias("turn_count"),
        F.max("opened_by").alias("_opened"),
        *[F.first(c, ignorenulls=True).alias(c) for c in keep],
    )
    line = Window.partitionBy(base).orderBy("segment")
    return rows.select(
        F.col("session_id").alias("id"), base, "segment", "started_at", "ended_at", "turn_count",
        F.coalesce(F.lead("_opened").over(line), F.lit("open")).alias("ended_reason"),
        F.lag("session_id").over(line).alias("resumed_from"), *keep,
    )
