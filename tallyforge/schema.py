"""The usage-event table and how other tables are brought into its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.times import stamp, utc_date, wall

COUNTERS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
DIMENSIONS = ("model", "session_id", "project")
PROVIDERS = ("claude_code", "codex")
UNKNOWN = "unknown"

USAGE_EVENTS = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("event_key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("model", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("source_file", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        T.StructField("line_no", T.LongType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)


def from_events(events: DataFrame) -> DataFrame:
    """The driver's ``events`` table as usage events, one per row."""
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    named = events.select(
        F.when(F.col("event_id") % 3 == 0, "codex").otherwise("claude_code").alias("provider"),
        F.col("event_id").cast("string").alias("message_id"),
        ts_ms.alias("ts_ms"),
        F.col("event_type").alias("model"),
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("proj-"), F.col("user_id") % 7).alias("project"),
        F.concat(F.lit("/logs/s"), F.col("user_id"), F.lit(".jsonl")).alias("source_file"),
        F.round(F.col("value") * 100).cast("long").alias("input_tokens"),
        number.alias("output_tokens"),
        (F.col("event_id") % 97).alias("cache_creation_input_tokens"),
        (F.col("user_id") * 3).alias("cache_read_input_tokens"),
        F.col("event_id").alias("line_no"),
        F.lit(0).cast("long").alias("ingest_seq"),
    )
    return complete(named)


def complete(named: DataFrame) -> DataFrame:
    """Add the derived columns and put all in the canonical order and types."""
    ts = F.timestamp_millis("ts_ms")
    full = named.withColumns({"ts": ts, "event_date": utc_date(F.col("ts_ms"))})
    if "event_key" not in named.columns:
        millis = F.lpad(F.pmod("ts_ms", F.lit(1000)).cast("string"), 3, "0")
        full = full.withColumn("event_key", F.concat_ws(":", "message_id", F.concat(stamp(wall(ts)), F.lit("."), millis, F.lit("Z"))))
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in USAGE_EVENTS.fields])
