"""Actions on closed sessions: gates, tags and the audit log."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import set_values
from .query import last_fired

WRITE_TOOLS, OPS_TOOLS = ("Edit", "Write", "NotebookEdit"), ("Bash",)  # fixed values


def closed_events(sessions: DataFrame, *, newest: int | None = None) -> DataFrame:
    """session_id, actor, at: an event for each stored session."""
    rows = sessions if newest is None else sessions.orderBy(F.desc("started_at"), "id").limit(newest)
    return rows.select(F.col("id").alias("session_id"), "actor", F.coalesce("ended_at", "started_at").alias("at"))


def task_type(turns: DataFrame) -> DataFrame:
    """session_id, task_type, by the tools a session used."""
    used = lambda tools: F.max(F.coalesce(F.col("tool_name").isin(*tools), F.lit(False)))
    flags = turns.groupBy("session_id").agg(used(WRITE_TOOLS).alias("w"), used(OPS_TOOLS).alias("o"), F.max(F.coalesce(F.col("tool_name") != "", F.lit(False))).alias("any"))
    return flags.select("session_id", F.when(F.col("w"), "implementation").when(F.col("o"), "ops").when(F.col("any"), "exploration").otherwise("conversation").alias("task_type"))


def friction_tags(compactions: DataFrame) -> DataFrame:
    """session_id, outcome, friction: the distinct categories, sorted, joined by commas; null without any."""
    joined = F.array_join(F.array_sort(F.array_distinct(F.col("friction_points.category"))), ",")
    return compactions.select("session_id", "outcome", F.when(F.size("friction_points") > 0, joined).alias("friction"))


def tags(sessions: DataFrame, turns: DataFrame, compactions: DataFrame) -> DataFrame:
    """id, tags (map): project, task type, and outcome and friction where the session has a compaction."""
    rows = sessions.select("id", "project").join(task_type(turns).withColumnRenamed("session_id", "id").hint("merge"), "id", "left")
    of = friction_tags(compactions.filter(F.col("id") == F.concat(F.lit("comp-"), "session_id"))).withColumnRenamed("session_id", "id")
    rows = rows.join(of.hint("merge"), "id", "left")
    pairs = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("project", F.col("project")), ("task_type", F.coalesce("task_type", F.lit("conversation"))), ("outcome", F.col("outcome")), ("friction", F.col("friction")))]
    return rows.select("id", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())).alias("tags"))


def apply_tags(sessions: DataFrame, new: DataFrame) -> DataFrame:
    return set_values(sessions, new.select("id", "tags"), ["id"])


def thin(events: DataFrame, history: DataFrame, seconds: float, *, key=("action_id", "actor")) -> DataFrame:
    """`events` (key, at, fires) with `cooling`: whether the last fired one of its key, in history (key, last_fired_at) or earlier in the batch, is under
    `seconds` ago. Only events that fire reset the clock, so each key is a sequential fold; it runs over times alone. Events at one time follow each other by session, if they have one."""
    rows = with_history(events, history, key)
    if not seconds:
        return rows.withColumn("cooling", F.lit(False)).drop("before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "before") + ", cooling boolean"

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("at", "session_id") if c in table.column_names])
        at = np.asarray(table.column("at").cast(pa.int64()))
        fires, last = table.column("fires").to_pylist(), table.column("before").cast(pa.int64())[0].as_py()
        cooling = []
        for t, f in zip(at.tolist(), fires, strict=True):
            cool = last is not None and t - last < seconds * 1_000_000
            cooling.append(cool)
            if f and not cool:
                last = t
        return table.drop_columns(["before"]).append_column("cooling", pa.array(cooling))

    return rows.groupBy(*key).applyInArrow(fold, schema)


def with_history(events: DataFrame, history: DataFrame, key) -> DataFrame:
    """`events` with `before`, the time when its key last fired according to `history`."""
    past = history.select(*[F.col(k).alias(f"_h_{k}") for k in key], F.col("last_fired_at").alias("before"))
    on = [events[k].eqNullSafe(past[f"_h_{k}"]) for k in key]
    return events.join(past.hint("merge"), on, "left").drop(*[f"_h_{k}" for k in key])


GATED = ("action_id", "actor", "session_id", "at", "fires", "gate", "outcome", "trigger_condition", "confidence", "details", "error")


def _below(threshold: float | None) -> Column:
    return F.coalesce(F.col("confidence") < F.lit(threshold), F.lit(False)) if threshold is not None else F.lit(False)


def gated(events: DataFrame, sessions: DataFrame, consent: DataFrame, results: DataFrame, *, action_id: str, threshold: float | None = None, org_consent: DataFrame | None = None) -> DataFrame:
    """Events with the first gate before the cooldown that stops them (`gate`), their handler's result, and whether they fire unless they are cooling. Works on a stream of events
    beside tables: each join has one key and keeps the stream's rows."""
    e = events.withColumn("action_id", F.lit(action_id))
    e = e.join(sessions.select(F.col("id").alias("session_id"), "mode").hint("merge"), "session_id", "left")
    out = consent.filter((F.col("action_category") == action_id) & (F.col("state") == "opt_out")).select(F.col("subject").alias("actor"), F.lit(True).alias("_out")).distinct()
    e = e.join(out.hint("merge"), "actor", "left").join(results.hint("merge"), "session_id", "left")
    opted_out = F.coalesce("_out", F.lit(False))
    if org_consent is not None:
        no = org_consent.filter((F.col("action_category") == action_id) & (F.col("state") == "opt_out")).agg(F.count("*").alias("n"))
        opted_out = opted_out | (no.scalar() > 0)
    gate = F.when(F.col("mode").isNull(), "session_unresolved").when(F.col("mode") == "personal", "personal_mode_excluded").when(opted_out, "consent_opt_out")
    e = e.withColumn("gate", gate).withColumn("fires", F.col("gate").isNull() & F.col("error").isNull() & ~_below(threshold) & (F.coalesce("outcome", F.lit("failed")) == "fired"))
    return e.select(*GATED)


def audited(e: DataFrame, threshold: float | None = None) -> DataFrame:
    """The audit rows of gated events that have `cooling`."""
    low = _below(threshold)
    reason = F.coalesce("gate", F.when(F.col("cooling"), "cooldown"))
    verdict = F.when(reason.isNotNull(), "suppressed").when(F.col("error").isNotNull(), "failed").when(low, "suppressed").otherwise(F.coalesce("outcome", F.lit("failed")))
    why = F.coalesce(reason, F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), "error")), F.when(low, "below_confidence_threshold"), F.col("trigger_condition"), F.lit("session_not_found"))
    ran = reason.isNull() & F.col("error").isNull()
    key = F.concat(F.lit("audit-"), F.substring(F.sha2(F.concat_ws("|", "action_id", "actor", "session_id", F.col("at").cast("string")), 256), 1, 12))
    return e.select(key.alias("id"), "action_id", "actor", "session_id", F.col("at").alias("fired_at"), why.alias("trigger_condition"), F.when(ran, F.col("confidence")).alias("confidence"), verdict.alias("outcome"), F.when(ran & ~low, F.col("details")).alias("details"))


def dispatch(events: DataFrame, sessions: DataFrame, consent: DataFrame, audit: DataFrame, results: DataFrame, *, action_id: str, cooldown: float | None = None, threshold: float | None = None, org_consent: DataFrame | None = None) -> DataFrame:
    """An audit row for each event: the first gate that stops it, or its handler's result.

    Gates in order: session unknown, personal session, opted out (by the actor, or by the org where `org_consent` is given),
    cooldown, error, confidence under `threshold`. `results`: session_id, outcome, trigger_condition, confidence, details, error.
    """
    e = gated(events, sessions, consent, results, action_id=action_id, threshold=threshold, org_consent=org_consent)
    return audited(thin(e, last_fired(audit), cooldown or 0), threshold)


def tag_results(new: DataFrame) -> DataFrame:
    """Handler results of tagging: every tagged session fires."""
    return new.select(F.col("id").alias("session_id"), F.lit("fired").alias("outcome"), F.lit("session_closed").alias("trigger_condition"), F.lit(None).cast("double").alias("confidence"), F.to_json("tags").alias("details"), F.lit(None).cast("string").alias("error"))


def allowed(opted: Column, org_opted: Column, personal: Column) -> Column:
    """Consent over levels: a person's refusal holds for their data, the org's across its border, personal sessions never pass."""
    return ~(F.coalesce(personal, F.lit(False)) | F.coalesce(opted, F.lit(False)) | F.coalesce(org_opted, F.lit(False)))
