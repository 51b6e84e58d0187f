"""Retention, rollups, replication and incremental export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import token_array, total_tokens
from tallyforge.functions.times import DAY_MS, utc_date
from tallyforge.operators.usage import between_ms, page_after
from tallyforge.schema import COUNTERS

HOUR_MS = 3_600_000
PAGE = 1_000


def retain(df: DataFrame, now_ms: int, days: int, time: str = "ts_ms") -> DataFrame:
    """Without rows older than ``days``; a row exactly that old stays; 0 days keeps all.
    Date partitions before the boundary's are pruned where the table has them."""
    if not days:
        return df
    least = now_ms - days * DAY_MS
    kept = df.where(F.col(time) >= least)
    return kept.where(F.col("event_date") >= utc_date(F.lit(least))) if "event_date" in df.columns else kept


def build_rollup(df: DataFrame) -> DataFrame:
    """Hourly sums by provider and model."""
    hour = F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR_MS))
    return df.groupBy(hour.alias("hour_ms"), "provider", "model").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("event_count"))


def usage_from_rollup(rollup: DataFrame, step_s: int | None = None) -> DataFrame:
    """Per-model usage from the rollup, per bucket of whole hours if asked."""
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, "event_count")]
    if step_s is None:
        return rollup.groupBy("model").agg(*sums)
    if step_s % 3600:
        raise ValueError("a rollup answers buckets of whole hours")
    bucket = F.col("hour_ms") - F.pmod("hour_ms", F.lit(step_s * 1000))
    return rollup.groupBy(bucket.alias("bucket_ms"), "model").agg(*sums)


def rollup_deltas(after: DataFrame, before: DataFrame) -> DataFrame:
    """What the rollup changes by when some days' events change: hours and models with the signed
    differences of their sums. Hours that stay the same are left out."""
    sums = (*COUNTERS, "event_count")
    signed = build_rollup(after).unionByName(build_rollup(before).withColumns({c: -F.col(c) for c in sums}))
    out = signed.groupBy("hour_ms", "provider", "model").agg(*[F.sum(c).alias(c) for c in sums])
    return out.where(" OR ".join(f"{c} <> 0" for c in sums))


def merge_rollup(rollup: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rollup after signed differences; hours without events are dropped."""
    sums = (*COUNTERS, "event_count")
    both = rollup.select("hour_ms", "provider", "model", *sums).unionByName(deltas.select("hour_ms", "provider", "model", *sums))
    return both.groupBy("hour_ms", "provider", "model").agg(*[F.sum(c).alias(c) for c in sums]).where("event_count <> 0")


def range_usage(events: DataFrame, rollup: DataFrame, since_ms: int, until_ms: int, provider: str | None = None) -> DataFrame:
    """Per-model usage of a range, both ends inclusive: whole hours from the rollup, the ragged ends
    from events. Raw rows of two hours are read at most; both tables are pruned by day."""
    first, last = -(-since_ms // HOUR_MS) * HOUR_MS, (until_ms + 1) // HOUR_MS * HOUR_MS
    sums = (*COUNTERS, "event_count")
    ends = [(since_ms, until_ms)] if first >= last else [(a, b) for a, b in ((since_ms, first - 1), (last, until_ms)) if a <= b]
    parts = [between_ms(events, a, b).select("provider", "model", *COUNTERS, F.lit(1).cast("long").alias("event_count")) for a, b in ends]
    if first < last:
        hours = rollup.where((F.col("hour_ms") >= first) & (F.col("hour_ms") < last))
        if "event_date" in rollup.columns:
            hours = hours.where(F.col("event_date").between(utc_date(F.lit(first)), utc_date(F.lit(last - 1))))
        parts.append(hours.select("provider", "model", *sums))
    rows = reduce(DataFrame.unionByName, parts)
    if provider is not None:
        rows = rows.where(F.col("provider") == provider)
    return rows.groupBy("model").agg(*[F.sum(c).alias(c) for c in sums])


def replicate(df: DataFrame, n: int, shift_days: int = 30, jitter_ms: int = HOUR_MS) -> DataFrame:
    """n copies of each event, each ``shift_days`` later with a hashed jitter and a fresh id."""
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    jitter = F.pmod(F.xxhash64("message_id", "_k"), F.lit(2 * jitter_ms + 1)) - jitter_ms
    moved = F.col("ts_ms") + F.col("_k") * F.lit(shift_days * DAY_MS).cast("long") + F.when(F.col("_k") == 0, 0).otherwise(jitter)
    fresh = F.when(F.col("_k") == 0, F.col("message_id")).otherwise(F.concat_ws("-", "message_id", "_k"))
    out = copies.withColumns({"ts_ms": moved, "message_id": fresh})
    ts: Column = F.timestamp_millis("ts_ms")
    return out.withColumns({"ts": ts, "event_date": utc_date(F.col("ts_ms"))}).drop("_k")


def export_rows(df: DataFrame, *more: str) -> DataFrame:
    """Rows on the wire: bare id, counters as an array with their names, and the total."""
    return df.select(
        *more,
        "ts_ms", "message_id", "model", "session_id", "project", "provider", token_array().alias("tokens"),
        F.array(*[F.lit(c) for c in COUNTERS]).alias("token_columns"), total_tokens(F.col("provider")).alias("usage_total"),
    )


def export_after(df: DataFrame, ts_ms: int, message_id: str, n: int = PAGE) -> DataFrame:
    """The next page after a cursor; its last row is the next cursor."""
    return export_rows(page_after(df, ts_ms, message_id, n))


def export_pages(df: DataFrame, n: int = PAGE) -> DataFrame:
    """A full export in one job: every row with its ``page`` (from 0), the pages that ``export_after``
    gives one by one. Rows are numbered within their hour; hours start where the counts of the hours
    before them end (a row for each hour), so no task sorts more than an hour."""
    hour = F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR_MS))
    rows = df.withColumn("_hour", hour)
    counts = rows.groupBy("_hour").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_hour").orderBy("ts_ms", "message_id")) - 1
    paged = rows.withColumn("_at", place).join(starts, "_hour").withColumn("page", F.floor((F.col("_start") + F.col("_at")) / n).cast("long"))
    return export_rows(paged, "page")


def page_end(rollup: DataFrame, ts_ms: int, n: int) -> int | None:
    """The last millisecond of the hour by which at least n events follow a cursor, from the rollup's
    counts; None if fewer do. Only the cursor's own hour is not counted on."""
    later = rollup.where(F.col("hour_ms") > ts_ms)
    if "event_date" in rollup.columns:
        later = later.where(F.col("event_date") >= utc_date(F.lit(ts_ms)))
    hours = later.groupBy("hour_ms").agg(F.sum("event_count").alias("n"))
    so_far = Window.orderBy("hour_ms").rowsBetween(Window.unboundedPreceding, 0)
    found = hours.withColumn("so_far", F.sum("n").over(so_far)).where(F.col("so_far") >= n).agg(F.min("hour_ms").alias("hour")).first()
    return None if found.hour is None else found.hour + HOUR_MS - 1


def export_page(df: DataFrame, rollup: DataFrame, ts_ms: int, message_id: str, n: int = PAGE) -> DataFrame:
    """``export_after`` that reads no further than the page: up to the hour that the rollup beside
    the table names."""
    return export_after(between_ms(df, ts_ms, page_end(rollup, ts_ms, n)), ts_ms, message_id, n)


def cursor(page: DataFrame) -> tuple[int, str] | None:
    """The cursor after a page: one row, from an aggregation."""
    last = page.agg(F.max(F.struct("ts_ms", "message_id")).alias("c")).first()["c"]
    return (last["ts_ms"], last["message_id"]) if last else None


def used_dimensions(df: DataFrame) -> DataFrame:
    """(dimension, name): the strings that a batch uses."""
    names = ("model", "session_id", "project", "source_file")
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("name")) for n in names]))
    return df.select(stacked.alias("d")).select("d.*").where("name IS NOT NULL").distinct()
