"""Registered queries against their SQL on the smallest tables, and streams against batch."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from worklens import queries as Q
from worklens.plans import views
from worklens.streaming import live

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({Q.ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, name):
    Q.QUERIES[name](spark, D).write.format("noop").mode("overwrite").save()


def stream(spark, tmp_path):
    rows = views.turns(spark, D).select(F.concat("transcript", F.lit("-"), "seq").alias("id"), "transcript", "seq", "timestamp").orderBy("timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), rows


def test_stream_gap_sessions(spark, tmp_path):
    s, rows = stream(spark, tmp_path)
    query = live.gap_sessions(s, gap="8 hours").writeStream.format("memory").queryName("gaps").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    pick = ["transcript", "started_at", "ended_at", "turn_count"]
    assert plain(spark.table("gaps").select(*pick).collect()) == plain(live.gap_sessions(rows, gap="8 hours").select(*pick).collect())


def test_stream_capped_sessions(spark, tmp_path):
    s, rows = stream(spark, tmp_path)
    query = live.capped_sessions(s, gap=8 * 3600, cap=86400, late="400 days").writeStream.format("memory").queryName("caps").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = Q.sessions(spark, D).filter("ended_reason <> 'open'")
    got = spark.table("caps").filter("ended_reason <> 'open'").select("transcript", "number", "turn_count", "ended_reason").collect()
    assert plain(got) == plain(closed.select("transcript", "segment", "turn_count", "ended_reason").collect())


def test_each_batch_is_retried(spark, tmp_path):
    s, rows = stream(spark, tmp_path)
    seen = []
    live.each_batch(live.once(s, "400 days"), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), every=None).awaitTermination()
    assert sum(seen) == rows.count()
