"""Transcripts into stored sessions and turns, in full or only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import replace_family
from ..operators.sessionize import CAP, GAP, sessions, split_turns
from ..sources.files import read_lines_of
from ..sources.transcripts import changed, discover, file_facts, flatten, next_ledger, objects, summaries
from .state import settle


def ingest(lines: DataFrame, *, actor: str, surface="claude_code", mode="work", gap=GAP, cap=CAP) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of the given lines, with base_session_id (the file's stem) as their family."""
    objs = objects(lines)
    facts, digest = file_facts(objs), summaries(lines).select("path", F.lit(True).alias("has_compact_summary"))
    turns = flatten(objs).join(facts.select("path", "stem", "mtime", "project", "cwd").hint("merge"), "path")
    split = split_turns(turns, base="stem", gap=gap, cap=cap)
    rows = sessions(split, base="stem", fallback="mtime", keep=("project", "path"))
    rows = rows.join(digest.hint("merge"), "path", "left").withColumn("has_compact_summary", F.coalesce("has_compact_summary", F.lit(False)))
    out = rows.withColumns({"actor": F.lit(actor), "surface": F.lit(surface), "mode": F.lit(mode)}).withColumnRenamed("stem", "base_session_id").withColumnRenamed("path", "source_path")
    kept = split.withColumn("seq", F.col("new_seq")).withColumn("actor", F.lit(actor)).withColumnRenamed("stem", "base_session_id")
    return out, kept.drop("new_seq", "opened_by", "segment", "mtime", "cwd", "project", "path", "line_no", "block")


def quarantine(old: DataFrame | None, failed: DataFrame, found: DataFrame) -> DataFrame:
    """path, mtime, error, tries of files that couldn't be read: those of this cycle with their tries counted on, and those of before that weren't tried again. A file that was
    read since, or is gone, leaves."""
    if old is None:
        return failed.select("path", "mtime", "error", F.lit(1).alias("tries"))
    tries = failed.join(old.select("path", F.col("tries").alias("_before")).hint("merge"), "path", "left")
    return tries.select("path", "mtime", "error", (F.coalesce("_before", F.lit(0)) + 1).alias("tries"))


def capture(spark: SparkSession, root: str, ledger: DataFrame, stored: tuple[DataFrame, DataFrame] | None = None, failures: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One cycle over changed files: the new sessions and turns tables, the new ledger (path, mtime) and the new quarantine (path, mtime, error, tries).

    Unchanged files aren't read. Changed ones are read on executors; one that can't be read stands in the quarantine, stays off the ledger, and is tried again in
    the next cycle, while what was stored of it before stays."""
    return cycle(spark, discover(spark, root), ledger, stored, failures, **options)


def cycle(spark: SparkSession, found: DataFrame, ledger: DataFrame, stored: tuple[DataFrame, DataFrame] | None = None, failures: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """capture() for files that were found otherwise (path, mtime)."""
    found = settle(found)
    lines, failed = read_lines_of(changed(found, ledger))
    lines, failed = settle(lines), settle(failed)
    new = ingest(lines, **options)
    if stored is not None:
        new = replace_family(*stored, *new)
    return *new, next_ledger(found, ledger, lines.select("path").distinct()), quarantine(failures, failed, found)
