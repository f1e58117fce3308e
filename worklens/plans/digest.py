"""Compacting what waits: sessions without a digest, their prompts, the responses, and the digests put into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.compact import assemble, prompts
from ..operators.query import pending
from ..schemas import COMPACTION_LISTS, FRICTION
from ..sources.tables import KeyedTable, read_table, replace_table, table_exists
from .state import settle

COMPACTION = f"""id string, session_id string, actor string, surface string, project string, started_at timestamp, ended_at timestamp, duration_seconds double, task_intent string, approach string,
artifacts array<string>, outcome string, friction_points {FRICTION}, reusable_pattern boolean, tier_used string, est_cost_usd double, prompt_version string, source string, released boolean,
{", ".join(f"{c} array<string>" for c in COMPACTION_LISTS)}"""
ANSWER = "session_id string, raw string"
Respond = Callable[[DataFrame], DataFrame]


def answered(waiting: DataFrame, turns: DataFrame, respond: Respond, summaries: DataFrame | None = None, instructions: str = "") -> DataFrame:
    """session_id, raw: what `respond` makes of the waiting sessions' prompts (session_id, prompt). A null response, or none, is a failure."""
    mine = turns.join(waiting.select(waiting.id.alias("session_id")).hint("merge"), "session_id", "left_semi")
    # stored before anything is asked of them, as a filter or a second reader would ask again
    return settle(respond(prompts(waiting, mine, summaries, instructions)).select("session_id", "raw")).filter("raw is not null")


def digests(waiting: DataFrame, turns: DataFrame, answers: DataFrame, summaries: DataFrame | None = None, prompt_version: str = "v0") -> DataFrame:
    """Compactions of those waiting sessions that have an answer; text that holds no JSON object gives one of defaults."""
    mine = turns.join(answers.select("session_id").hint("merge"), "session_id", "left_semi")
    columns = ("id", "actor", "surface", "project", "started_at", "ended_at")
    return assemble(waiting.select(*columns), mine, answers, summaries, prompt_version)


def compact_pending(sessions: DataFrame, turns: DataFrame, compactions: DataFrame, respond: Respond, summaries: DataFrame | None = None, *, summarised_only=False, instructions="", prompt_version="v0") -> DataFrame:
    """New compactions of all sessions that are not personal and have none. Sessions whose response fails have no row, so they stay pending."""
    waiting = settle(pending(sessions, compactions, summarised_only=summarised_only))
    return digests(waiting, turns, answered(waiting, turns, respond, summaries, instructions), summaries, prompt_version)


class DigestChain:
    """compact_pending() for batches that may come again: `stream.writeStream.foreachBatch(DigestChain(...))`.

    A batch (closed sessions) gets its responses once: they are stored under the batch's number as one versioned table before any digest is made of them, and a batch that comes again
    takes them from there. Digests are put into `table` by session, in place. So a replay after a failure at any point ends in the same table, and no response is asked for
    twice once it is stored. `turns` and `summaries` are read when a batch runs.
    """

    def __init__(self, table: KeyedTable, answers: str, turns: Callable[[], DataFrame], respond: Respond, summaries: Callable[[], DataFrame] | None = None, **options):
        self.table, self.answers, self.turns, self.respond, self.summaries, self.options = table, answers, turns, respond, summaries, options

    def __call__(self, batch: DataFrame, number: int | str) -> None:
        spark, name = batch.sparkSession, f"batch-{number}"
        turns, summaries = self.turns(), self.summaries() if self.summaries else None
        waiting = pending(batch, self.table.read(), summarised_only=self.options.get("summarised_only", False)).dropDuplicates(["id"])
        if not table_exists(spark, self.answers, name):
            replace_table(answered(waiting, turns, self.respond, summaries, self.options.get("instructions", "")), self.answers, name)
        answers = read_table(spark, self.answers, name, ANSWER)
        self.table.upsert(digests(waiting, turns, answers, summaries, self.options.get("prompt_version", "v0")), ["id"])


def digest_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The table that a DigestChain fills, in folders by session."""
    return KeyedTable(spark, path, COMPACTION, "session_id", buckets)
