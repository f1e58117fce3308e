"""Table schemas and the values that coded columns may take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = """id string, session_id string, actor string, seq bigint, timestamp timestamp, role string, content string, tool_name string,
tool_input string, tool_output string, tool_use_id string, model string, tokens_in bigint, tokens_out bigint,
cache_creation_tokens bigint, cache_read_tokens bigint, error string, source_event_id string, source_parent_id string"""
FRICTION = "array<struct<category:string,description:string,turn_refs:array<string>>>"
COMPACTION_LISTS = ("files_touched", "prs_opened", "tests_added", "dead_end_branches", "languages", "frameworks")
AUDIT = "id string, action_id string, actor string, fired_at timestamp, trigger_condition string, confidence double, outcome string, useful boolean, details string"

# fixed values of coded columns
DOMAINS = {
    "surface": ("claude_code", "codex", "cursor"),
    "role": ("user", "assistant", "tool"),
    "mode": ("work", "personal"),
    "outcome": ("success", "partial", "abandoned"),
    "friction": ("loop", "tool_error", "abandon", "retry", "deadend"),
    "ended_reason": ("gap", "stop_hook", "cap", "open"),
    "action_outcome": ("fired", "suppressed", "failed"),
    "queue_status": ("pending", "approved", "rejected"),
    "consent": ("opt_in", "opt_out", "default"),
    "source": ("full", "claude_summary"),
}


def in_domain(column: str, domain: str) -> Column:
    """True where a column holds one of its domain's values, or null."""
    return F.col(column).isNull() | F.col(column).isin(*DOMAINS[domain])


def violations(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows whose coded columns (name: domain) hold other values, with the names of these in `bad`."""
    bad = F.array_compact(F.array(*[F.when(~in_domain(c, d), F.lit(c)) for c, d in columns.items()]))
    return df.withColumn("bad", bad).filter(F.size("bad") > 0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
