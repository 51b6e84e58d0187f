"""Dates and local times that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def wall(ts: Column, tz: str = "UTC") -> Column:
    """Local date and time of an instant, without a zone: whatever the session's zone is."""
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01").cast("timestamp_ntz"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def stamp(local: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a time without a zone."""
    text = local.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def utc_date(ts_ms: Column) -> Column:
    """The day in UTC of epoch milliseconds, by which event tables are partitioned."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / DAY_MS).cast("int"))
