"""The query surface: totals, buckets, groups, filters, lists and listings of usage events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions.arguments import time_ms
from tallyforge.functions.times import utc_date
from tallyforge.operators.pricing import with_cost
from tallyforge.schema import COUNTERS, DIMENSIONS, UNKNOWN

METRICS = ("usage", "events", "cost")
AGGREGATIONS = ("sum", "avg", "count")
LABELS = {"sum": "(total)", "avg": "(avg/event)", "count": "(count)"}
GROUPS = {"model": "model", "session": "session_id", "project": "project", "provider": "provider"}
#: Fixed steps of the report cadences in seconds, and their calendar units.
CADENCES = {"hourly": 3_600, "daily": 86_400, "weekly": 604_800, "monthly": 30 * 86_400, "yearly": 365 * 86_400}
UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


@dataclass(frozen=True)
class Match:
    """A full match of one of the names joined by pipes."""

    names: str


def re_(names: str) -> Match:
    return Match(names)


def _condition(key: str, value: str | Match) -> Column:
    column = F.col(GROUPS[key])
    if isinstance(value, Match):
        return column.isin(*value.names.split("|"))
    if key == "session":
        return column.startswith(value)
    if key == "project":
        return column.contains(value)
    return column == value


def between_ms(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Both ends inclusive. Days are filtered too, so that date partitions are pruned."""
    if since is not None:
        df = df.where((F.col("ts_ms") >= since) & (F.col("event_date") >= utc_date(F.lit(since))))
    if until is not None:
        df = df.where((F.col("ts_ms") <= until) & (F.col("event_date") <= utc_date(F.lit(until))))
    return df


def filtered(
    df: DataFrame, since=None, until=None, where: Mapping[str, str | Match] | None = None,
    provider: str | None = None, tz: str | None = None, offset: int | None = None,
) -> DataFrame:
    """Events under all filters; a bounded side moves back by ``offset`` seconds, an open
    side stays open."""
    if offset is not None and offset <= 0:
        raise ValueError("offset must be positive")
    shift = 1000 * (offset or 0)
    since, until = time_ms(since, tz), time_ms(until, tz, is_until=True)
    df = between_ms(df, None if since is None else since - shift, None if until is None else until - shift)
    if provider is not None:
        df = df.where(F.col("provider") == provider)
    for key, value in (where or {}).items():
        if key == "type":
            df = C.mask_types(df, value.names if isinstance(value, Match) else value)
        elif key in GROUPS:
            df = df.where(_condition(key, value))
        else:
            raise ValueError(f"unknown filter: {key}")
    return df


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS]


def usage(
    df: DataFrame, metric: str = "usage", since=None, until=None, tz: str | None = None,
    where: Mapping[str, str | Match] | None = None, bucket: int | None = None, by: Sequence[str] = (),
    agg: str | None = None, offset: int | None = None, provider: str | None = None,
    calendar: str | None = None, week_start: int = 0, pricing: DataFrame | None = None,
) -> DataFrame:
    """Token usage as one aggregation.

    Rows are per model, or per group of ``by``, and per bucket: ``bucket`` seconds wide
    from the epoch (``bucket_ms`` and ``period``), or a ``calendar`` unit of local time
    (``period``). A fixed bucket that starts at or after ``until`` is left out although the
    event range includes its end. ``agg`` without ``by`` folds each bucket into one row;
    ``avg`` divides counters by events in whole numbers. With ``pricing`` a ``cost`` is
    summed from the models' own costs before any folding; null if no model has a price.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if agg is not None and agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {agg}")
    if bad := [k for k in by if k not in GROUPS]:
        raise ValueError(f"unknown group: {', '.join(bad)}")
    if len(set(by)) < len(by):
        raise ValueError("a group is named twice")
    if bucket is not None and (bucket <= 0 or calendar):
        raise ValueError("a bucket is a positive number of seconds, or a calendar unit")
    if metric == "cost" and pricing is None:
        raise ValueError("cost needs a price list")
    rows = filtered(df, since, until, where, provider, tz, offset)
    dims: list[str] = []
    if bucket is not None:
        rows = rows.withColumn("bucket_ms", C.bucket_ms(F.col("ts_ms"), bucket))
        end = time_ms(until, tz, is_until=True)
        if end is not None:
            rows = rows.where(F.col("bucket_ms") < end - 1000 * (offset or 0))
        dims = ["bucket_ms"]
    elif calendar:
        rows = rows.withColumn("period", C.calendar_bucket(F.col("ts"), calendar, tz or "UTC", week_start))
        dims = ["period"]
    groups = [GROUPS[k] for k in by]
    keys = [*dims, *groups] + ([] if groups else ["model"])
    priced = pricing is not None
    per_model = [*keys] + ([] if "model" in keys or not priced else ["model"])
    out = rows.groupBy(*per_model).agg(*_sums(), F.count("*").alias("event_count"))
    if priced:
        out = with_cost(out, pricing)
    folded = [k for k in keys if groups or k != "model"] if agg else keys
    if folded != per_model:
        cost = [F.sum("cost").alias("cost")] if priced else []
        out = out.groupBy(*folded).agg(*_sums(), F.sum("event_count").alias("event_count"), *cost)
        if not folded:
            out = out.where("event_count IS NOT NULL")
    if agg == "avg":
        count = F.greatest("event_count", F.lit(1))
        out = out.withColumns({c: F.expr(f"{c} div greatest(event_count, 1)") for c in COUNTERS} | ({"cost": F.col("cost") / count} if priced else {}))
        out = out.withColumn("event_count", F.lit(1).cast("long"))
    if agg == "count" or metric == "events":
        out = out.withColumns({c: F.lit(0).cast("long") for c in COUNTERS} | ({"cost": F.lit(0.0)} if priced and agg == "count" else {}))
    if agg and not groups:
        out = out.withColumn("model", F.lit(LABELS[agg]))
    if bucket is not None:
        out = out.withColumn("period", C.bucket_label(F.col("bucket_ms"), bucket, tz))
    if metric == "cost":
        out = out.drop(*COUNTERS)
    names = [*dims, *(["period"] if bucket is not None else []), *groups, *([] if groups else ["model"])]
    return out.select(*names, *[c for c in (*COUNTERS, "event_count", "cost") if c in out.columns])


def report(df: DataFrame, cadence: str, calendar: bool = False, **arguments) -> DataFrame:
    """One of the five cadences: fixed steps from the epoch, or calendar units."""
    if cadence not in CADENCES:
        raise ValueError(f"unknown cadence: {cadence}")
    if calendar:
        return usage(df, calendar=UNITS[cadence], **arguments)
    return usage(df, bucket=CADENCES[cadence], **arguments)


def usage_by_session(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "model").agg(*_sums(), F.count("*").alias("event_count"))


def sessions(df: DataFrame, prefix: str | None = None, project: str | None = None, since=None, until=None, provider: str | None = None) -> DataFrame:
    where = {k: v for k, v in (("session", prefix), ("project", project)) if v is not None}
    return filtered(df, since, until, where, provider).select("session_id").distinct().orderBy("session_id")


def projects(df: DataFrame, contains: str | None = None, since=None, until=None, provider: str | None = None) -> DataFrame:
    where = {"project": contains} if contains is not None else {}
    found = filtered(df, since, until, where, provider).where((F.col("project") != UNKNOWN) & F.col("project").isNotNull())
    return found.select("project").distinct().orderBy("project")


def data_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def with_totals(summary: DataFrame, keys: Sequence[str], always: bool = False) -> DataFrame:
    """A summary with a last row of totals (``is_total``): for a flat report only if it has
    more than one row. One pass by grouping sets."""
    measures = [c for c in (*COUNTERS, "event_count", "cost") if c in summary.columns]
    sets = summary.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in measures]
    )
    shown = sets if always else sets.where("_g = 0 OR _n > 1")
    return shown.select(*keys, *measures, (F.col("_g") != 0).alias("is_total"))


def merge_summaries(summaries: Sequence[DataFrame], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Partial summaries as one: counters and counts add up."""
    return reduce(DataFrame.unionByName, summaries).groupBy(*keys).agg(*_sums(), F.sum("event_count").alias("event_count"))


def sort_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("event_count"), "model")


def sort_grouped(summary: DataFrame) -> DataFrame:
    return summary.orderBy("period", F.desc("event_count"), "model")


def scan(df: DataFrame, since=None, until=None) -> DataFrame:
    return between_ms(df, time_ms(since), time_ms(until, is_until=True)).orderBy("ts_ms", "message_id")


def scan_limit(df: DataFrame, since, until, n: int) -> DataFrame:
    """The first n events of a range; a bounded top-n, not a full sort."""
    return scan(df, since, until).limit(n)


def page_after(df: DataFrame, ts_ms: int, message_id: str, n: int) -> DataFrame:
    """The next n events after (time, id); equal times are not lost between pages."""
    later = (F.col("ts_ms") > ts_ms) | ((F.col("ts_ms") == ts_ms) & (F.col("message_id") > message_id))
    return between_ms(df, ts_ms, None).where(later).orderBy("ts_ms", "message_id").limit(n)


def events(df: DataFrame, where: Mapping[str, str | Match] | None = None, tz: str = "UTC", since=None, until=None, provider: str | None = None, pricing: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Raw listing with local times; with prices also the total and cost of each event."""
    rows = filtered(df, since, until, where, provider, tz)
    names = ["ts_ms", "message_id", *DIMENSIONS, *COUNTERS]
    if pricing is not None:
        rows = with_cost(rows, pricing).withColumn("total_tokens", C.total_tokens(F.col("provider")))
        names += ["total_tokens", "cost"]
    out = rows.select(C.local_time(F.col("ts"), tz).alias("local_time"), *names)
    return out.orderBy("ts_ms", "message_id") if ordered else out
