"""Column functions on times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

APPLE_EPOCH_SECONDS = 978_307_200


def from_apple_ns(value: Column) -> Column:
    """Nanoseconds since 2001 as a timestamp, cut to microseconds; 0 and null are no time."""
    return F.when(value != 0, F.timestamp_micros(F.lit(APPLE_EPOCH_SECONDS * 1_000_000) + F.call_function("div", value - F.pmod(value, F.lit(1000)), F.lit(1000))))


def to_apple_ns(ts: Column) -> Column:
    return F.coalesce((F.unix_micros(ts) - APPLE_EPOCH_SECONDS * 1_000_000) * 1000, F.lit(0))


def lenient_iso(text: Column) -> Column:
    """The time of an ISO text, null for anything else."""
    return F.try_to_timestamp(text)


def local_midnight(day: str, timezone: str) -> Column:
    """The instant at which a day (YYYY-MM-DD) begins in a time zone."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"not a day: {day!r}")
    return F.to_utc_timestamp(F.lit(day).cast("timestamp"), timezone)


def backoff_seconds(attempts: Column, base: int = 60) -> Column:
    """Exponential: the base doubles with every attempt after the first."""
    return F.lit(base) * F.pow(F.lit(2.0), attempts - 1)


def after_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds * 1_000_000).cast("long"))


def slots(window: Column | str, minutes: int = 30) -> Column:
    """Minutes of the day from the start of ``HH:MM-HH:MM`` to its end, inclusive; a window over midnight is an error."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    window = F.lit(window) if isinstance(window, str) else window
    part = [F.regexp_extract(window, r"^(\d{2}):(\d{2})-(\d{2}):(\d{2})$", i).try_cast("int") for i in (1, 2, 3, 4)]
    start, end = part[0] * 60 + part[1], part[2] * 60 + part[3]
    return F.when(start.isNull() | end.isNull() | (end <= start), F.raise_error(F.concat(F.lit("bad window: "), window))).otherwise(F.sequence(start, end, F.lit(minutes)))
