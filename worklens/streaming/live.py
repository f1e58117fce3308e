"""Sessions and releases as streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "transcript string, number long, started_at timestamp, ended_at timestamp, turn_count long, ended_reason string"


def gap_sessions(turns: DataFrame, *, gap="30 minutes", late="1 hour") -> DataFrame:
    """Sessions by inactivity, for a stream or a table of turns (transcript, timestamp): events `gap` apart exactly still belong together."""
    rows = turns.withWatermark("timestamp", late) if turns.isStreaming else turns
    s = rows.groupBy("transcript", F.session_window("timestamp", gap).alias("w")).agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("turn_count"))
    return s.select("transcript", "started_at", "ended_at", "turn_count")


class CappedSessions(StatefulProcessor):
    """Closes a transcript's sessions by a pause over `gap` or a length over `cap` seconds, as split_turns() does over a table.

    State: the last session's number, its first and last time (microseconds), its turns (0: it was closed by the timer), turns that wait for a first time,
    and when its timer rings. A turn without a time takes the last one seen; turns before any time wait and belong to the first session.
    A timer closes a session when the watermark has passed its last turn by the gap. The number of sessions stays for `forget` seconds more, so that a later one
    counts on; then the transcript is forgotten.
    """

    def __init__(self, gap: float, cap: float, forget: float | None = None):
        self.gap, self.cap, self.forget = int(gap * 1_000_000), int(cap * 1_000_000), None if forget is None else int(forget * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "number long, start long, last long, n long, waiting long, timer long")

    def _rows(self, key, closed: list[tuple]) -> pd.DataFrame:
        at = lambda k: pd.to_datetime([c[k] for c in closed], unit="us")
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"transcript": text([key[0]] * len(closed)), "number": [c[0] for c in closed], "started_at": at(1), "ended_at": at(2), "turn_count": [c[3] for c in closed], "ended_reason": text([c[4] for c in closed])})

    def _set_timer(self, old: int, at: int, timers) -> int:
        if old >= 0:
            self.handle.deleteTimer(old)
        at = max(at // 1000 + 1, timers.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows, timerValues):
        number, start, last, n, waiting, timer = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, -1)
        turns, closed = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        times = turns["timestamp"].astype("datetime64[us]")
        for t, missing in zip(times.astype("int64").tolist(), times.isna().tolist(), strict=True):
            if missing:
                if n:
                    n += 1
                else:  # before any time, or after the timer closed the session that it would belong to
                    waiting += 1
                continue
            why = None if not n else "gap" if t - last > self.gap else "cap" if t - start > self.cap else None
            if why:
                closed.append((number, start, last, n, why))
            if why or not n:
                number, start, n, waiting = number + 1, t, waiting, 0
            last, n = t, n + 1
        if n:
            timer = self._set_timer(timer, last + self.gap, timerValues)
        self.state.update((number, start, last, n, waiting, timer))
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        number, start, last, n, waiting, _ = self.state.get()
        if n:
            timer = -1 if self.forget is None else self._set_timer(-1, last + self.gap + self.forget, timerValues)
            self.state.update((number, start, last, 0, waiting, timer))
            yield self._rows(key, [(number, start, last, n, "open")])
        else:
            self.state.clear()
            yield self._rows(key, [])

    def close(self) -> None:
        pass


def capped_sessions(turns: DataFrame, *, gap=30 * 60, cap=6 * 3600, late="1 hour", forget: float | None = None) -> DataFrame:
    """Sessions of a stream of turns (transcript, seq, timestamp), closed as CappedSessions says: each transcript's turns come in the order of `seq`, batch after batch. Timed
    turns that come after the watermark are dropped. Needs the RocksDB state store, which is set for the session."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = turns.select("transcript", "seq", "timestamp").withWatermark("timestamp", late)
    return rows.groupBy("transcript").transformWithStateInPandas(CappedSessions(gap, cap, forget), SESSION, "Append", "EventTime")


def once(turns: DataFrame, late="1 hour") -> DataFrame:
    """Turns delivered again are dropped, by id within the watermark."""
    return turns.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def each_batch(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = "60 seconds"):
    """Run `work` on each micro-batch, at most once in `every` (None: all that is available, then stop); a failed batch comes again."""
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
