"""GPS, UTC and local time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that UTC is behind GPS time.
LEAP = -18
#: Days from the year 1 to 1970, as ordinals count them.
EPOCH_ORDINAL = 719163


def ordinal_to_utc(days: Column) -> Column:
    """Timestamp from days since the year 1."""
    return F.timestamp_micros(F.round((days.cast("double") - EPOCH_ORDINAL) * 86_400_000_000).cast("long"))


def week_seconds_to_utc(week: Column, seconds: Column, leap: int = LEAP) -> Column:
    """UTC from GPS week and seconds of the week; weeks count from 1980-01-06."""
    start = 315_964_800
    return F.timestamp_micros(F.round((F.lit(start) + week.cast("long") * 604_800 + leap) * 1_000_000 + seconds.cast("double") * 1_000_000).cast("long"))


def gps_stamp_to_utc(stamp: Column, week: Column) -> Column:
    """UTC from a stamp in 1/1024 seconds."""
    return week_seconds_to_utc(week, stamp / F.lit(1024.0))


def to_local(utc: Column, zone: str = "America/Denver") -> Column:
    """Wall clock time of a zone (by the IANA rules), without a zone of its own."""
    return F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")


def week_seconds_to_local(week: Column, seconds: Column, zone: str = "America/Denver") -> Column:
    """Wall clock time from GPS week and seconds of the week, fractions kept."""
    return to_local(week_seconds_to_utc(week, seconds), zone)


def sample_times(start: Column, end: Column, n: Column) -> Column:
    """n evenly spaced timestamps from start to end, both included."""
    a, b = F.unix_micros(start.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    step = (b - a) / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.timestamp_micros(F.round(a + i * step).cast("long")))


def start_and_end(first_stamp: Column, last_stamp: Column, week: Column, rate: Column | None = None) -> tuple[Column, Column]:
    """UTC of the first and last record (the week after, if the seconds start anew); with a rate up to the last sample."""
    last_week = week + F.when(last_stamp < first_stamp, 1).otherwise(0)
    seconds = last_stamp / F.lit(1024.0) + (F.lit(0.0) if rate is None else (rate - 1) / rate)
    return gps_stamp_to_utc(first_stamp, week), week_seconds_to_utc(last_week, seconds)
