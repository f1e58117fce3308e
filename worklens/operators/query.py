"""Listing, filtering and summing up sessions and compactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import since_bound, until_bound, within
from ..schemas import DOMAINS


def newest(rows: DataFrame, time="started_at", limit: int | None = None, *tie: str) -> DataFrame:
    rows = rows.orderBy(F.desc(time), *tie)
    return rows if limit is None else rows.limit(limit)


def listing(rows: DataFrame, *, time="started_at", limit: int | None = None, tie: tuple[str, ...] = ("id",), **equal) -> DataFrame:
    """Rows with the given column values (None: any), newest first."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return newest(rows, time, limit, *tie)


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The rows under a key; none if it is missing."""
    for column, value in key.items():
        rows = rows.filter(F.col(column) == value)
    return rows


def session_turns(turns: DataFrame, session_id: str, order="seq") -> DataFrame:
    return turns.filter(F.col("session_id") == session_id).orderBy(order)


def org_query(rows: DataFrame, *, org_id: str, team_id=None, project=None, outcome=None, actor=None, surface=None, since=None, until=None, source=None, limit=None) -> DataFrame:
    """Released rows of one org under a filter, newest first. Unknown outcomes, surfaces and sources don't filter."""
    outcome = outcome if outcome in DOMAINS["outcome"] else None
    surface = surface if surface in DOMAINS["surface"] else None
    rows = rows.filter((F.col("org_id") == org_id) & F.col("released"))
    rows = rows.filter(since_bound(F.col("started_at"), since)).filter(until_bound(F.col("started_at"), until)).filter(of_source(source))
    return listing(rows, team_id=team_id, project=project, outcome=outcome, actor=actor, surface=surface, limit=limit)


def of_source(source: str | None) -> Column:
    """Rows made the given way; a row that doesn't say was made from the full transcript."""
    return F.coalesce("source", F.lit("full")) == source if source in DOMAINS["source"] else F.lit(True)


def recent(rows: DataFrame, start, *, scan_limit: int | None = None, time="started_at") -> DataFrame:
    """Rows since `start` (None: all); with `scan_limit`, of the newest so many only."""
    rows = rows if scan_limit is None else newest(rows, time, scan_limit, "id")
    return rows.filter(within(F.col(time), start))


def owned(rows: DataFrame, org_id: str, team_id: str) -> DataFrame:
    return rows.filter((F.col("org_id") == org_id) & (F.col("team_id") == team_id) & F.col("released"))


def orgs(rows: DataFrame) -> DataFrame:
    """org_id of every org that has rows."""
    return rows.filter(F.col("org_id").isNotNull()).select("org_id").distinct()


def teams(rows: DataFrame, org_id: str) -> DataFrame:
    """team_id of every team of an org."""
    return rows.filter((F.col("org_id") == org_id) & F.col("team_id").isNotNull()).select("team_id").distinct()


def audit(entries: DataFrame, *, action_id=None, actor=None, limit: int | None = None) -> DataFrame:
    """Audit rows of an action and an actor (None: any), newest first."""
    return listing(entries, time="fired_at", limit=limit, action_id=action_id, actor=actor)


def consents(entries: DataFrame, *, subject: str | None = None, org_id: str | None = None) -> DataFrame:
    """Consent entries, of a subject or an org (None: any), by their key."""
    for c, v in (("subject", subject), ("org_id", org_id)):
        entries = entries if v is None else entries.filter(F.col(c) == v)
    return entries.orderBy("id")


def pending(sessions: DataFrame, compactions: DataFrame, *, summarised_only=False) -> DataFrame:
    """Sessions still to be compacted: not personal, without a compaction."""
    rows = sessions.filter(F.col("mode") != "personal")
    rows = rows.filter("has_compact_summary") if summarised_only else rows
    return rows.join(compactions.select(F.col("session_id").alias("id")).distinct().hint("merge"), "id", "left_anti")


def review(sessions: DataFrame, compactions: DataFrame, limit: int | None = 200) -> DataFrame:
    """Newest sessions, with the tags they carry and a flag for those that have a compaction."""
    done = compactions.select(F.col("session_id").alias("id")).distinct().withColumn("compacted", F.lit(True))
    return newest(sessions, "started_at", limit, "id").join(done.hint("merge"), "id", "left").withColumn("compacted", F.coalesce("compacted", F.lit(False)))


def top_per_group(rows: DataFrame, by: str, time: str, n: int, *tie: str) -> DataFrame:
    """The newest n rows of each group."""
    order = Window.partitionBy(by).orderBy(F.desc(time), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def head_tail(turns: DataFrame, *, by="session_id", order="seq", head: int | None = None, tail: int | None = None) -> DataFrame:
    """The first `head` or the last `tail` turns of each session."""
    line = Window.partitionBy(by).orderBy(F.col(order).asc() if head is not None else F.col(order).desc())
    n = head if head is not None else tail
    return turns.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= n).drop("_r")


def insights(sessions: DataFrame, compactions: DataFrame, costs: DataFrame, *, start=None, scan_limit=None, cost_sessions: int | None = None, friction=5) -> dict[str, DataFrame]:
    """Counts by project and outcome, total cost and the newest friction descriptions."""
    s, c = (recent(x, start, scan_limit=scan_limit) for x in (sessions, compactions))
    priced = s if cost_sessions is None else newest(s, "started_at", cost_sessions, "id")
    total = priced.select("id").join(costs.withColumnRenamed("session_id", "id").hint("merge"), "id").agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 4).alias("total_usd"))
    points = c.select("id", "started_at", F.posexplode("friction_points").alias("pos", "point")).select("id", "started_at", "pos", "point.description")
    return {
        "by_project": s.groupBy("project").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "project"),
        "by_outcome": c.groupBy("outcome").agg(F.count("*").alias("compactions")),
        "cost": total,
        "friction": points.orderBy(F.desc("started_at"), "id", "pos").limit(friction),
    }


def org_overview(teams: DataFrame, released: DataFrame, queue: DataFrame, orgs: DataFrame) -> DataFrame:
    """Teams, released compactions and pending items of each org."""
    counts = [
        teams.groupBy("org_id").agg(F.count_distinct("team_id").alias("teams")),
        released.filter("released").groupBy("org_id").agg(F.count("*").alias("compactions")),
        queue.filter("status = 'pending'").groupBy("org_id").agg(F.count("*").alias("pending")),
    ]
    out = orgs.select("org_id").distinct()
    for c in counts:
        out = out.join(c, "org_id", "left")
    return out.fillna(0, ["teams", "compactions", "pending"])


def ingest_summary(sessions: DataFrame, base="transcript") -> DataFrame:
    return sessions.agg(F.count_distinct(base).alias("files"), F.count("*").alias("sessions"), F.sum("turn_count").alias("turns"))


def last_fired(audit: DataFrame) -> DataFrame:
    """When each action last fired for each actor (null actors are one of them)."""
    return audit.filter("outcome = 'fired'").groupBy("action_id", "actor").agg(F.max("fired_at").alias("last_fired_at"))
