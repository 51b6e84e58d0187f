"""Latest-wins deduplication, upserts and unions of usage events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, horizon_h: int | None = None, keys: Sequence[str] = ("provider", "message_id"), partitions: int | None = None) -> DataFrame:
    """One event per message: within a file the last line wins, across files the latest
    ingest, then the latest time, then the greater file name.

    Rows are shuffled once, by message; the last line of each file and then the best file are
    found by sorting there, which spills; ``partitions`` is for rows known to be too many for the
    session's number of shuffle partitions. With ``horizon_h`` an event more than that many hours
    after the one before it starts a new row, as if the id had been forgotten meanwhile."""
    if horizon_h is not None:
        order = Window.partitionBy(*keys).orderBy("ts_ms", "ingest_seq", "line_no")
        new = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) > horizon_h * 3_600_000, F.lit(True))
        runs = df.withColumn("_new", new.cast("int"))
        return latest(runs.withColumn("_run", F.sum("_new").over(order)), None, (*keys, "_run"), partitions).drop("_new", "_run")
    # By the message alone: a provider that is the same for all rows is a constant to Spark, which
    # would shuffle again for each window. The windows' keys have the message among them.
    by = [k for k in keys if k != "provider"] or keys
    dealt = df.repartition(partitions, *by) if partitions else df.repartition(*by)
    in_file = Window.partitionBy(*keys, "source_file").orderBy(F.desc("ingest_seq"), F.desc("line_no"))
    last = dealt.withColumn("_n", F.row_number().over(in_file)).where("_n = 1")
    best = Window.partitionBy(*keys).orderBy(F.desc("ingest_seq"), F.desc("ts_ms"), F.desc("source_file"))
    return last.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _arrived(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with what orders the versions of a message, and the names to order by: files stand by
    the ingest, time and name of their last version, as ``latest`` ranks them, and a file's versions
    by ingest and line. One shuffle, by message."""
    in_file = Window.partitionBy(*keys, "source_file").orderBy("ingest_seq", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.repartition(*keys).withColumn("_file", F.last(F.struct("ingest_seq", "ts_ms", "source_file")).over(in_file))
    return rows, ["_file", "ingest_seq", "line_no"]


def last_per_id(df: DataFrame, keys: Sequence[str] = ("provider", "message_id")) -> DataFrame:
    """The last version of each message in arrival order, by window: the one that ``latest`` keeps."""
    rows, by = _arrived(df, keys)
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_file")


def superseded(df: DataFrame, keys: Sequence[str] = ("provider", "message_id")) -> DataFrame:
    """Events that a later version of the same message replaced, with what replaced them: every
    version but the one that ``latest`` keeps."""
    rows, by = _arrived(df, keys)
    order = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("replaced_by_ts_ms", F.lead("ts_ms").over(order)).where("replaced_by_ts_ms IS NOT NULL").drop("_file")


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``stored`` after ``batch`` replaced the messages that it holds. The batch counts as
    later than all that is stored."""
    new = latest(batch)
    kept = stored.join(new.select("provider", "message_id").distinct(), ["provider", "message_id"], "left_anti")
    return kept.unionByName(new)


def only_new(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` that were not ingested before, by file and event key."""
    return batch.join(stored.select("source_file", "event_key"), ["source_file", "event_key"], "left_anti")


def union_providers(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("provider", F.lit(p)) for p, df in tables.items()])


def union_devices(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per message over all devices; the latest version wins."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("device", F.lit(d)) for d, df in tables.items()])
    return latest(tagged)
