"""What may leave its owner: the gate, the batch, its ledger and the org's side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.redact import redact_compactions, redact_turns
from ..sources.files import write_files
from .keyed import mark_synced, upsert


def eligible(compactions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Released compactions of known sessions that aren't personal. All that leaves passes through here."""
    known = sessions.filter(F.col("mode") != "personal").select(F.col("id").alias("session_id")).distinct()
    return compactions.filter("released").join(known.hint("merge"), "session_id", "left_semi")


def unsynced(rows: DataFrame, ledger: DataFrame, *, raw=False) -> DataFrame:
    done = ledger.filter(F.col("raw_synced_at" if raw else "synced_at").isNotNull()).select(F.col("compaction_id").alias("id"))
    return rows.join(done.hint("merge"), "id", "left_anti")


def release_batch(compactions: DataFrame, sessions: DataFrame, ledger: DataFrame, active=None) -> DataFrame:
    """What the next sync sends: eligible, not sent before, redacted."""
    return redact_compactions(unsynced(eligible(compactions, sessions), ledger), active)


def sync(batch: DataFrame, ledger: DataFrame, path: str, when) -> tuple[DataFrame, int]:
    """Write a batch, hold what can be read back against what was given, and only then mark it: the new ledger and the number sent."""
    spark = batch.sparkSession
    given = Observation("sync")
    batch.observe(given, F.count(F.lit(1)).alias("n")).write.parquet(path)
    sent = spark.read.schema(batch.schema).parquet(path)
    ids, n = sent.select("id"), sent.count()
    if n != given.get["n"]:
        raise ValueError("the batch was not received whole; nothing was marked")
    if n != sent.select("id").distinct().count():
        raise ValueError("the batch repeats ids; nothing was marked")
    return mark_synced(ledger, ids, when), n


def raw_export(rows: DataFrame, turns: DataFrame, active=None) -> DataFrame:
    """org_id, team_id, compaction_id, value: the redacted turns of each compaction as JSON lines."""
    redacted = redact_turns(turns, active)
    owner = rows.select("org_id", "team_id", F.col("id").alias("compaction_id"), "session_id")
    return redacted.join(owner.hint("merge"), "session_id").select("org_id", "team_id", "compaction_id", "seq", F.to_json(F.struct(*turns.columns)).alias("value"))


def write_raw(lines: DataFrame, path: str) -> DataFrame:
    """Write org/team/compaction folders of JSON lines; returns the pointer rows."""
    placed = lines.repartition("org_id", "team_id", "compaction_id").sortWithinPartitions("org_id", "team_id", "compaction_id", "seq")
    placed.drop("seq").write.partitionBy("org_id", "team_id", "compaction_id").text(path)
    return lines.select(F.concat_ws("::", F.lit("raw"), "org_id", "compaction_id").alias("id"), "org_id", "team_id", "compaction_id", F.concat_ws("/", F.lit(path), "org_id", "team_id", "compaction_id").alias("path")).distinct()


def export_raw(lines: DataFrame, root: str) -> DataFrame:
    """Write org/team/compaction.jsonl files of raw_export()'s lines, in the order of `seq`; returns the pointer rows (id, org_id, team_id, compaction_id, path)."""
    named = lines.select(F.concat(F.concat_ws("/", "org_id", "team_id", "compaction_id"), F.lit(".jsonl")).alias("name"), F.col("seq").alias("no"), F.col("value").alias("line"))
    parts = F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30), "/")
    rows = write_files(named, root).select(parts[0].alias("org_id"), parts[1].alias("team_id"), F.regexp_replace(parts[2], r"\.jsonl$", "").alias("compaction_id"), "path")
    return rows.select(F.concat_ws("::", F.lit("raw"), "org_id", "compaction_id").alias("id"), "org_id", "team_id", "compaction_id", "path")


def org_ingest(stored: DataFrame, batch: DataFrame, claims: DataFrame) -> DataFrame:
    """Upsert a batch into the org's table. A row that isn't released, an unknown credential or an id that an org sends twice refuses the whole batch. Actor, org and team
    come from the claims (credential, actor, org_id, team_id; one row each), never from the payload; keys get the org before them."""
    ok = batch.agg(F.bool_and(F.coalesce("released", F.lit(False))).alias("ok")).first().ok
    if ok is False:
        raise ValueError("a batch may hold released rows only")
    payload = batch.drop("actor", "org_id", "team_id")
    if not payload.join(claims.select("credential").hint("merge"), "credential", "left_anti").isEmpty():
        raise ValueError("a batch may come from known credentials only")
    bound = payload.join(claims.hint("merge"), "credential").drop("credential")
    keyed = bound.withColumn("id", F.concat(F.col("org_id"), F.lit("::"), F.col("id")))
    if not keyed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a batch may hold an id once only")
    return upsert(stored, keyed.select(*stored.columns), ["id"])


def raw_allowed(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads whose compaction the same org and team own and have released."""
    own = stored.filter("released").select("org_id", "team_id", F.element_at(F.split("id", "::"), -1).alias("compaction_id"))
    return uploads.join(own.hint("merge"), ["org_id", "team_id", "compaction_id"], "left_semi")


def enqueue(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (id, action_id, org_id, team_id, payload, created_at) appended as pending."""
    return queue.unionByName(rows.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def record_query(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (id, org_id, query, citations, created_at, insufficient) appended: text cut to 500 characters, citations counted."""
    return audit.unionByName(rows.withColumn("query", F.substring("query", 1, 500)).withColumn("citation_count", F.size("citations").cast("long")), allowMissingColumns=True)
