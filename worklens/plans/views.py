"""The given tables as turns, compactions and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as turns: a transcript for each user, tools by the kind of event, tokens by its value."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    model = F.element_at(F.array(*map(F.lit, ("x-haiku-1", "x-opus-1", "x-sonnet-1", "other-1"))), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("transcript"),
        F.concat(F.lit("p"), F.col("user_id") % 7).alias("project"),
        F.concat(F.lit("u"), "user_id").alias("actor"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "signup", "user").when(kind == "error", "tool").otherwise("assistant").alias("role"),
        F.when(kind == "purchase", "Edit").when(kind == "error", "Bash").when(kind.isin("click", "view"), "Read").alias("tool_name"),
        F.when(kind == "error", "failed").alias("error"),
        model.alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("tokens_in"),
        F.floor(F.col("value") * 10).cast("long").alias("tokens_out"),
        (F.col("event_id") % 50).alias("cache_creation_tokens"),
        (F.col("event_id") % 300).alias("cache_read_tokens"),
        "event_id", "props",
    )


TURNS_SQL = """
select 'u' || user_id as transcript, 'p' || (user_id % 7) as project, 'u' || user_id as actor,
  row_number() over (partition by user_id order by ts, event_id) - 1 as seq, ts,
  case event_type when 'purchase' then 'Edit' when 'error' then 'Bash' when 'click' then 'Read' when 'view' then 'Read' end as tool_name,
  case when event_type = 'signup' then 'user' when event_type = 'error' then 'tool' else 'assistant' end as role,
  ['x-haiku-1', 'x-opus-1', 'x-sonnet-1', 'other-1'][user_id % 4 + 1] as model,
  cast(floor(value * 100) as bigint) as tokens_in, cast(floor(value * 10) as bigint) as tokens_out,
  event_id % 50 as cache_creation_tokens, event_id % 300 as cache_read_tokens, event_id, props
from events
"""


def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as compactions: 40 actors, project by priority, org and team by the customer's nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    key = F.col("o_orderkey")
    return rows.select(
        F.concat(F.lit("comp-s"), key).alias("id"),
        F.concat(F.lit("s"), key).alias("session_id"),
        key.alias("key"),
        F.concat(F.lit("a"), F.col("o_custkey") % 40).alias("actor"),
        F.element_at(F.array(*map(F.lit, ("claude_code", "codex", "cursor"))), (key % 3 + 1).cast("int")).alias("surface"),
        F.col("o_orderpriority").alias("project"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").otherwise("abandoned").alias("outcome"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_totalprice").alias("est_cost_usd"),
        (key % 5 != 0).alias("released"),
        F.when(key % 3 == 0, "claude_summary").when(key % 3 == 1, "full").alias("source"),
        F.when(key % 11 == 0, "personal").otherwise("work").alias("mode"),
        F.concat(F.lit("org"), "n_regionkey").alias("org_id"),
        F.concat(F.lit("team"), "n_nationkey").alias("team_id"),
    )


COMPACTIONS_SQL = """
select 'comp-s' || o_orderkey as id, 's' || o_orderkey as session_id, o_orderkey as key, 'a' || (o_custkey % 40) as actor,
  ['claude_code', 'codex', 'cursor'][o_orderkey % 3 + 1] as surface, o_orderpriority as project,
  case o_orderstatus when 'F' then 'success' when 'O' then 'partial' else 'abandoned' end as outcome,
  o_orderdate as started_at, o_totalprice as est_cost_usd, o_orderkey % 5 <> 0 as released,
  case o_orderkey % 3 when 0 then 'claude_summary' when 1 then 'full' end as source,
  case when o_orderkey % 11 = 0 then 'personal' else 'work' end as mode,
  'org' || n_regionkey as org_id, 'team' || n_nationkey as team_id
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""


def friction(rows: DataFrame) -> DataFrame:
    """Compactions with friction points derived from their keys."""
    point = F.struct(
        F.element_at(F.array(*map(F.lit, ("loop", "tool_error", "abandon", "retry", "deadend"))), (F.col("key") % 5 + 1).cast("int")).alias("category"),
        F.concat(F.lit("point "), "key").alias("description"), F.array(F.col("id")).alias("turn_refs"),
    )
    return rows.withColumn("friction_points", F.when(F.col("key") % 4 == 0, F.array(point)).otherwise(F.array().cast("array<struct<category:string,description:string,turn_refs:array<string>>>")))
