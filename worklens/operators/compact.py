"""Digests of sessions: prompts out, responses in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import COMPACTION_LISTS, DOMAINS, FRICTION
from .cost import session_cost
from .query import head_tail

MAX_CHARS, MAX_TURNS, TAIL = 600, 400, 40


def turn_text(limit: int = MAX_CHARS) -> Column:
    text = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("tool_output"), F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def serialised(turns: DataFrame, *, order="seq") -> DataFrame:
    """session_id, turns: each session's turns, in order, as a JSON array of seq, role, text and tool."""
    item = F.struct(F.col(order).alias("seq"), "role", turn_text().alias("text"), F.when(F.col("tool_name") != "", F.col("tool_name")).alias("tool"))
    return turns.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("c")).select("session_id", F.to_json("c").alias("turns"))


def prompts(sessions: DataFrame, turns: DataFrame, summaries: DataFrame | None = None, instructions: str = "") -> DataFrame:
    """session_id, prompt: a header with the first 400 turns, or with the summary (session_id, summary) and the last 40."""
    head = F.concat(F.lit("Work in "), "project", F.lit(" by way of "), "surface", F.lit("; number of turns: "), "turn_count")
    s = sessions.select(F.col("id").alias("session_id"), head.alias("head"))
    s = s.join(summaries.hint("merge"), "session_id", "left") if summaries is not None else s.withColumn("summary", F.lit(None).cast("string"))
    summarised = F.col("summary").isNotNull() & (F.col("summary") != "")
    t = turns.join(s.select("session_id", summarised.alias("_tail")).hint("merge"), "session_id")
    full = serialised(head_tail(t.filter(~F.col("_tail")), head=MAX_TURNS))
    tail = serialised(head_tail(t.filter("_tail"), tail=TAIL))
    body = s.join(full.unionByName(tail).hint("merge"), "session_id", "left").withColumn("turns", F.coalesce("turns", F.lit("[]")))
    text = F.when(summarised, F.concat(F.lit(instructions + "\n"), "head", F.lit("\n\n# Summary so far\n"), "summary", F.lit("\n\n# Last turns, as JSON\n"), "turns", F.lit("\n")))
    return body.select("session_id", text.otherwise(F.concat(F.lit(instructions + "\n"), "head", F.lit("\n\n# Turns, as JSON\n"), "turns", F.lit("\n"))).alias("prompt"))


def first_object(raw: str | None, *, prefer: str | None = None) -> str | None:
    """The first JSON object in a text; with `prefer`, the last one that has this key, or else the last one."""
    if not raw:
        return None
    decoder, found, at = json.JSONDecoder(), [], 0
    while (at := raw.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(raw, at)
        except ValueError:
            at += 1
            continue
        found.append(value)
        if prefer is None:
            break
    if not found:
        return None
    return json.dumps(next((v for v in reversed(found) if prefer in v), found[-1]) if prefer else found[0], ensure_ascii=False)


def extract_object(raw: Column, *, prefer: str | None = None) -> Column:
    """JSON text of a response's object. Responses that begin with an object take the native path, as parsers end with it; the rest are searched row by row, and so are all if
    the preferred object may come later."""
    whole = F.when(F.trim(raw).startswith("{") & F.try_parse_json(raw).isNotNull(), raw) if prefer is None else F.lit(None).cast("string")

    @F.pandas_udf(StringType())
    def search(texts):
        return texts.map(lambda t: first_object(t, prefer=prefer), na_action="ignore")

    return F.coalesce(whole, search(F.when(whole.isNull(), raw)))


def string_list(value: Column) -> Column:
    """The strings and numbers of a JSON array (given as variant), as strings; booleans and other things are dropped."""
    items = F.coalesce(value.try_cast("array<variant>"), F.array().cast("array<variant>")) if hasattr(value, "try_cast") else value
    kind = lambda v: F.schema_of_variant(v)
    wanted = F.filter(items, lambda v: kind(v).isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind(v).startswith("DECIMAL"))
    return F.transform(wanted, lambda v: v.cast("string"))


def parsed(responses: DataFrame) -> DataFrame:
    """Typed fields of responses (session_id, raw), with defaults for all that is missing or wrong."""
    d = F.try_parse_json(extract_object(F.col("raw")))
    rows = responses.withColumn("_d", d)
    text = lambda name: F.expr(f"try_variant_get(_d, '$.{name}', 'string')")
    lists = {n: F.coalesce(string_list(F.expr(f"try_variant_get(_d, '$.{n}', 'variant')")), F.array().cast("array<string>")) for n in ("artifacts", *COMPACTION_LISTS)}
    points = F.expr(f"try_variant_get(_d, '$.friction_points', '{FRICTION}')")
    return rows.select(
        "session_id", F.when(text("task_intent") != "", text("task_intent")).alias("task_intent"), F.coalesce(text("approach"), F.lit("")).alias("approach"),
        F.when(text("outcome").isin(*DOMAINS["outcome"]), text("outcome")).otherwise("partial").alias("outcome"),
        F.coalesce(F.filter(points, lambda p: p["category"].isin(*DOMAINS["friction"])), F.array().cast(FRICTION)).alias("friction_points"),
        F.coalesce(F.expr("try_variant_get(_d, '$.reusable_pattern', 'boolean')"), F.lit(False)).alias("reusable_pattern"),
        *[c.alias(n) for n, c in lists.items()],
    )


def assemble(sessions: DataFrame, turns: DataFrame, responses: DataFrame, summaries: DataFrame | None = None, prompt_version: str = "v0") -> DataFrame:
    """Compactions: what is known of the session, its cost, and the parsed response; without an intent, the first words of its user."""
    said = F.when((F.col("role") == "user") & (F.col("content") != ""), F.col("seq"))
    first = turns.groupBy("session_id").agg(F.substring(F.min_by("content", said), 1, 200).alias("_first"))
    costs = session_cost(turns).select("session_id", F.col("tier").alias("tier_used"), F.col("usd").alias("est_cost_usd"))
    s = sessions.withColumnRenamed("id", "session_id")
    rows = s.join(parsed(responses).hint("merge"), "session_id").join(first.hint("merge"), "session_id", "left").join(costs.hint("merge"), "session_id", "left")
    rows = rows.join(summaries.hint("merge"), "session_id", "left") if summaries is not None else rows.withColumn("summary", F.lit(None).cast("string"))
    summarised = F.coalesce(F.col("summary") != "", F.lit(False))
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    return rows.select(
        F.concat(F.lit("comp-"), "session_id").alias("id"), "session_id", "actor", "surface", "project", "started_at", F.coalesce("ended_at", "started_at").alias("ended_at"),
        F.coalesce(F.greatest(F.lit(0.0), seconds), F.lit(0.0)).alias("duration_seconds"), F.coalesce("task_intent", "_first", F.lit("unknown")).alias("task_intent"), "approach", "artifacts",
        "outcome", "friction_points", "reusable_pattern", "tier_used", F.coalesce("est_cost_usd", F.lit(0.0)).alias("est_cost_usd"),
        F.concat(F.lit(prompt_version), F.when(summarised, "-summary").otherwise("")).alias("prompt_version"),
        F.when(summarised, "claude_summary").otherwise("full").alias("source"), F.lit(False).alias("released"), *COMPACTION_LISTS,
    )
