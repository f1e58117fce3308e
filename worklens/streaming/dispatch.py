"""Actions on live events: tables beside the stream for the gates, state for the cooldown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.actions import audited, gated, with_history
from ..operators.query import last_fired
from .live import ROCKS


class Cooldown(StatefulProcessor):
    """Marks events of an action and an actor as `cooling` while the last one that fired is under `seconds` ago. State: when it fired, one number for each key.
    Events of a batch are taken by time and session, batches as they come."""

    def __init__(self, seconds: float):
        self.cooldown = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fired long")

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows)).sort_values(["at", "session_id"], kind="stable")
        past = events["before"].dropna().astype("datetime64[us]").astype("int64")  # what history has, until the key has a state
        last, cooling = self.last.get()[0] if self.last.exists() else int(past.iloc[0]) if len(past) else None, []
        for t, fires in zip(events["at"].astype("datetime64[us]").astype("int64").tolist(), events["fires"].tolist(), strict=True):
            cooling.append(bool(self.cooldown) and last is not None and t - last < self.cooldown)
            if fires and not cooling[-1]:
                last = t
        if last is not None:
            self.last.update((last,))
        strings = {c: object for c in events.columns if c not in ("at", "fires", "confidence", "before")}
        yield events.astype(strings).drop(columns="before").assign(cooling=cooling)

    def close(self) -> None:
        pass


def dispatch_stream(events: DataFrame, sessions: DataFrame, consent: DataFrame, audit: DataFrame, results: DataFrame, *, action_id: str, cooldown: float | None = None, threshold: float | None = None, org_consent: DataFrame | None = None) -> DataFrame:
    """As actions.dispatch(), for a stream of events (session_id, actor, at): an audit row for each, and none is dropped for being late. `audit` says when a key had last fired
    as the stream meets it first; from then on the stream's own state holds. Tables beside the stream are read anew for each batch. Needs the RocksDB state store, which is set for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    e = gated(events, sessions, consent, results, action_id=action_id, threshold=threshold, org_consent=org_consent)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields) + ", cooling boolean"
    known = with_history(e, last_fired(audit), ("action_id", "actor"))
    marked = known.groupBy("action_id", "actor").transformWithStateInPandas(Cooldown(cooldown or 0), shape, "Append", "None")
    return audited(marked, threshold)
