"""Points in time as ISO text, durations before a point, and the age of one."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units of a duration; months and years are counted by the calendar.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_DURATION = re.compile(r"(\d+)(s|m|h|d|w|mo|y)", re.I)
_FORM = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def months_before(at: datetime, months: int) -> datetime:
    """The same day ``months`` earlier; a day that this month lacks runs over into the next one (31 March less one is 3 March, or 2)."""
    first = at.year * 12 + at.month - 1 - months
    return at.replace(year=first // 12, month=first % 12 + 1, day=1) + timedelta(days=at.day - 1)


def since(text: str, now: datetime) -> str:
    """The start of a scan in UTC: an ISO time, or a duration before ``now`` such as 15m, 2h, 7d, 1mo. Anything else raises a ValueError."""
    text = text.strip()
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        m = _DURATION.fullmatch(text)
        if not m:
            raise ValueError(f"neither a time nor a duration: {text!r}") from None
        n, unit = int(m[1]), m[2].lower()
        at = now - timedelta(seconds=n * UNITS[unit]) if unit in UNITS else months_before(now, n * (12 if unit == "y" else 1))
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    return at.isoformat(timespec="milliseconds").replace("+00:00", "Z")


def iso(at: Column) -> Column:
    return F.date_format(at, _FORM)


def months_earlier(at: Column, months: int) -> Column:
    """``months_before`` for a column of times."""
    first = F.add_months(F.trunc(at, "month"), -months)
    return F.timestamp_micros(F.unix_micros(first.cast("timestamp")) + F.unix_micros(at) - F.unix_micros(F.date_trunc("month", at)))


def age_hours(at: Column, now: Column) -> Column:
    """Whole hours from ``at`` to ``now``, 0 at least; null where either is."""
    hours = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(3_600_000_000))
    return F.when(hours < 0, F.lit(0)).otherwise(hours)
