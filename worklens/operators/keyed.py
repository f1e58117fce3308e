"""Keyed tables: upserts, flags, families and ledgers. Every function returns the table's new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(table: DataFrame, rows: DataFrame, key: list[str], *, version: str | None = None) -> DataFrame:
    """Rows replace those of equal key; among new rows of one key the largest `version` wins (without it, keys must be unique)."""
    if version is not None:
        order = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last())
        rows = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    return table.join(rows.select(*key).hint("merge"), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def set_values(table: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Columns of `updates` put in place where they aren't null; unknown keys change nothing."""
    new = {c: F.col(f"_new_{c}") for c in updates.columns if c not in key}
    renamed = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = table.join(renamed.hint("merge"), key, "left")
    return joined.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def release(table: DataFrame, ids: DataFrame, *, on=True, when: Column | None = None) -> DataFrame:
    """Set or clear `released` and `released_at` of the given ids."""
    hit = table.join(ids.select("id", F.lit(True).alias("_hit")).distinct().hint("merge"), "id", "left")
    time = F.lit(None).cast("timestamp") if not on else (F.current_timestamp() if when is None else when)
    hit = hit.withColumn("released", F.when(F.col("_hit"), F.lit(on)).otherwise(F.col("released")))
    return hit.withColumn("released_at", F.when(F.col("_hit"), time).otherwise(F.col("released_at"))).select(*table.columns)


def replace_family(sessions: DataFrame, turns: DataFrame, new_sessions: DataFrame, new_turns: DataFrame, *, base="base_session_id") -> tuple[DataFrame, DataFrame]:
    """All sessions and turns of the families in `new_sessions` replaced; compactions are another table and stay."""
    families = new_sessions.select(base).distinct()
    kept = [t.join(families.hint("merge"), base, "left_anti") for t in (sessions, turns)]
    return kept[0].unionByName(new_sessions), kept[1].unionByName(new_turns)


def delete_family(tables: list[DataFrame], families: DataFrame, *, base="base_session_id") -> tuple[list[DataFrame], DataFrame]:
    """The tables without the families, and how many rows each lost (table: place in the list)."""
    gone = families.select(base).distinct()
    kept = [t.join(gone.hint("merge"), base, "left_anti") for t in tables]
    lost = [t.join(gone.hint("merge"), base, "left_semi").agg(F.count("*").alias("removed")).withColumn("table", F.lit(i)) for i, t in enumerate(tables)]
    counts = lost[0]
    for more in lost[1:]:
        counts = counts.unionByName(more)
    return kept, counts.select("table", "removed")


def mark_synced(ledger: DataFrame, ids: DataFrame, when: Column, *, raw=False) -> DataFrame:
    """The ledger (compaction_id, synced_at, raw_synced_at) with one of its two times set; the other stays, so that it can be retried alone."""
    marks = ids.select(F.col("id").alias("compaction_id"), when.alias("_when")).distinct()
    both = ledger.join(marks.hint("merge"), "compaction_id", "full")
    field = "raw_synced_at" if raw else "synced_at"
    return both.withColumn(field, F.coalesce("_when", field)).select("compaction_id", "synced_at", "raw_synced_at")


def set_consent(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Latest decision for each subject and category; org rows have keys org:subject:category."""
    keyed = rows.withColumn("id", F.when(F.col("org_id").isNull(), F.concat_ws(":", "subject", "action_category")).otherwise(F.concat_ws(":", "org_id", "subject", "action_category")))
    return upsert(table, keyed, ["id"], version="set_at")
