"""Streams with state against the batch forms, over several micro-batches, timeouts and restarts."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from worklens.operators import sessionize
from worklens.streaming import live

T0 = 1_700_000_000
SHAPE = "transcript string, seq long, timestamp timestamp"


def at(seconds):
    return None if seconds is None else datetime.fromtimestamp(T0 + seconds, UTC)


def drain(rows, path, name, mode="append"):
    """Run a stream over what is there, then stop: as good as a restart, as the next call goes on from its checkpoint."""
    (rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode(mode).queryName(name).trigger(availableNow=True).start().awaitTermination())


def batches(rng, transcripts=12, parts=4):
    """Turns in file order with gaps, caps and missing times, leading ones too, dealt to micro-batches that keep each transcript's order; batches follow each other in time."""
    out = [[] for _ in range(parts)]
    for k in range(transcripts):
        t, seq = 0, 0
        for part in range(parts):
            t = max(t, part * 40_000)
            for _ in range(rng.randint(0, 12)):
                t += rng.choice([0, 60, 600, 1799, 1800, 1801, 3000])
                hidden = rng.random() < 0.25 or (k % 4 == 0 and seq < 2)
                out[part].append((f"f{k}", seq, None if hidden else at(t)))
                seq += 1
    return out


def test_capped_sessions_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(7)
    parts, every = batches(rng), []
    for i, part in enumerate(parts):
        every += part
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        turns = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        drain(live.capped_sessions(turns, gap=1800, cap=4000, late="100 days"), str(tmp_path), f"caps{i}")
    split = sessionize.split_turns(spark.createDataFrame(every, SHAPE), gap=1800, cap=4000)
    want = sessionize.sessions(split).filter("ended_reason <> 'open'").selectExpr("transcript", "segment", "started_at", "ended_at", "turn_count", "ended_reason").collect()
    got = spark.read.parquet(str(tmp_path / "out")).select("transcript", "number", "started_at", "ended_at", "turn_count", "ended_reason").collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_capped_sessions_close_by_the_watermark(spark, tmp_path):
    """A timer closes what is idle; the transcript counts on afterwards; a transcript of missing times alone never closes."""
    parts = [
        [("a", 0, None), ("a", 1, at(0)), ("a", 2, None), ("b", 0, at(100)), ("n", 0, None)],
        [("c", 0, at(50_000))],
        [("a", 3, None), ("a", 4, at(60_000)), ("c", 1, at(60_000)), ("n", 1, None)],
        [("c", 2, at(200_000))],
        [("c", 3, at(200_001))],
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(live.capped_sessions(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), gap=1800, cap=4000, late="1 minute"), str(tmp_path), f"idle{i}")
    got = {(r.transcript, r.number): (r.turn_count, r.started_at.timestamp() - T0, r.ended_at.timestamp() - T0, r.ended_reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): (3, 0, 0, "open"), ("a", 2): (2, 60_000, 60_000, "open"), ("b", 1): (1, 100, 100, "open"), ("c", 1): (1, 50_000, 50_000, "gap"), ("c", 2): (1, 60_000, 60_000, "gap")}


def test_forgotten_transcripts_begin_anew(spark, tmp_path):
    parts = [[("a", 0, at(0))], [("z", 0, at(10_000))], [("z", 1, at(90_000))], [("z", 2, at(90_001))], [("a", 1, at(95_000))], [("z", 3, at(200_000))], [("z", 4, at(200_001))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(live.capped_sessions(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), gap=1800, cap=4000, late="1 minute", forget=20_000), str(tmp_path), f"forget{i}")
    got = [(r.number, r.started_at.timestamp() - T0) for r in spark.read.parquet(str(tmp_path / "out")).filter("transcript = 'a'").orderBy("started_at").collect()]
    assert got == [(1, 0), (1, 95_000)]


def test_actions_on_live_events(spark, tmp_path):
    """The audit rows of a stream over four batches and restarts are those of one batch over all."""
    from worklens.operators import actions
    from worklens.streaming.dispatch import dispatch_stream

    rng, shape = random.Random(5), "session_id string, actor string, at timestamp"
    events = [(f"s{i}", rng.choice(["a", "b", "c", "d", None]), at(600 * i + rng.choice([0, 0, 60]))) for i in range(160)]
    sessions = spark.createDataFrame([(f"s{i}", "personal" if i % 11 == 0 else "work") for i in range(160) if i % 7], "id string, mode string")
    consent = spark.createDataFrame([("b", "tag", "opt_out"), ("c", "other", "opt_out")], "subject string, action_category string, state string")
    results = spark.createDataFrame([(f"s{i}", "fired" if i % 3 else "suppressed", "closed", (i % 10) / 10, "{}", "ValueError" if i % 13 == 0 else None) for i in range(160)], "session_id string, outcome string, trigger_condition string, confidence double, details string, error string")
    audit = spark.createDataFrame([("tag", "a", at(-100), "fired"), ("tag", "c", at(-9000), "fired"), ("tag", "d", at(-50), "suppressed"), ("tag", None, at(-10), "fired")], "action_id string, actor string, fired_at timestamp, outcome string")
    rules = {"action_id": "tag", "cooldown": 7200.0, "threshold": 0.2}
    for k in range(0, 160, 40):
        spark.createDataFrame(events[k : k + 40], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(dispatch_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), sessions, consent, audit, results, **rules), str(tmp_path), f"act{k}")
    want = actions.dispatch(spark.createDataFrame(events, shape), sessions, consent, audit, results, **rules)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 160
    assert {r.trigger_condition for r in got.select("trigger_condition").distinct().collect()} >= {"cooldown", "closed", "consent_opt_out", "session_unresolved", "personal_mode_excluded", "error:ValueError", "below_confidence_threshold"}


def test_digests_of_batches_that_come_again(spark, tmp_path):
    """A replay changes nothing and asks nobody, personal sessions never pass, a failed response stays pending and can be tried again."""
    from worklens.operators.query import pending
    from worklens.plans.digest import DigestChain, digest_table

    shape = "id string, actor string, surface string, project string, mode string, started_at timestamp, ended_at timestamp, turn_count long"
    closed = [(f"s{i}", "me", "codex", "p", "personal" if i % 5 == 0 else "work", at(i), at(i + 60), 1) for i in range(12)]
    turn = "session_id string, seq long, role string, content string, tool_name string, tool_output string, model string, tokens_in long, tokens_out long, cache_creation_tokens long, cache_read_tokens long"
    turns = spark.createDataFrame([(f"s{i}", 0, "user", f"do {i}", None, None, "opus", 1_000_000, 0, 0, 0) for i in range(12)], turn)
    asked, broken = [], {"s3"}

    def respond(prompts):
        rows = [(r.session_id, None if r.session_id in broken else '{"task_intent": "did %s (%d)", "outcome": "success"}' % (r.session_id, len(asked)) if r.session_id != "s4" else "no json") for r in prompts.collect()]
        asked.append(sorted(r[0] for r in rows))
        return spark.createDataFrame(rows, "session_id string, raw string")

    table = digest_table(spark, str(tmp_path / "digests"), buckets=4)
    chain = DigestChain(table, str(tmp_path / "answers"), lambda: turns, respond)
    for i, part in enumerate((closed[:6], closed[6:])):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(chain).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = lambda: {r.session_id: (r.id, r.task_intent, r.outcome, r.est_cost_usd) for r in table.read().collect()}
    first = rows()
    assert asked == [["s1", "s2", "s3", "s4"], ["s11", "s6", "s7", "s8", "s9"]] and set(first) == {"s1", "s2", "s4", "s6", "s7", "s8", "s9", "s11"}
    assert first["s1"] == ("comp-s1", "did s1 (0)", "success", 15.0) and first["s4"] == ("comp-s4", "do 4", "partial", 15.0)
    everything = spark.createDataFrame(closed, shape)
    chain(spark.createDataFrame(closed[:6], shape), 0)  # comes again after its end
    table.replace(spark.createDataFrame([("s1",), ("s7",)], "session_id string"), table.read().limit(0))
    chain(spark.createDataFrame(closed[:6], shape), 0)  # comes again after a failure between the answers and the table
    assert len(asked) == 2 and rows() == {k: v for k, v in first.items() if k != "s7"}
    assert sorted(r.id for r in pending(everything, table.read()).collect()) == ["s3", "s7"]
    broken.clear()
    chain(everything, "retry-1")
    assert asked[2] == ["s3", "s7"] and rows()["s3"][1] == "did s3 (2)" and set(rows()) == {f"s{i}" for i in range(12) if i % 5}


def test_batches_keep_their_distance(spark, tmp_path):
    """A trigger starts one batch in an interval at most."""
    import time

    first = time.time()
    spark.range(3).write.parquet(str(tmp_path / "in"))
    began = []
    query = live.each_batch(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lambda df, n: began.append(time.time()), str(tmp_path / "c"), every="3 seconds")
    try:
        query.processAllAvailable()
        spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert 2 <= len(began) <= (began[-1] - first) / 3 + 2
