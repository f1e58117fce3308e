"""Times as text: parsing, bounds and relative windows."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO 8601, also without separators, as a timestamp; null if it isn't."""
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))


def since_bound(column: Column, since: str | None) -> Column:
    """At or after `since`; a date means its midnight. None: always."""
    return F.lit(True) if not since else column >= F.to_timestamp(F.lit(since))


def until_bound(column: Column, until: str | None) -> Column:
    """At or before `until`; a date means the whole day. None: always."""
    if not until:
        return F.lit(True)
    if re.fullmatch(r"\d{4}-\d\d-\d\d", until):
        return column < F.to_timestamp(F.date_add(F.lit(until).cast("date"), 1))
    return column <= F.to_timestamp(F.lit(until))


def cutoff(since: str | None, now: datetime | None = None) -> datetime | None:
    """Where a window of `12h`, `7d` or `2w`, or one given by an ISO time, begins; None (all time) for anything else."""
    if not since:
        return None
    now = now or datetime.now(UTC)
    if m := re.fullmatch(r"(\d+)\s*([hdw])", since.strip().lower()):
        return now - int(m[1]) * {"h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}[m[2]]
    try:
        at = datetime.fromisoformat(since)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def within(column: Column, start: datetime | None) -> Column:
    return F.lit(True) if start is None else column >= F.lit(start)
