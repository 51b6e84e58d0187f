"""Registered streaming queries: the events table as a stream, run to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans import catalog
from tallyforge.plans.catalog import ALL_SQL, COST_SQL, COUNTERS_SQL, EVENTS_SQL, PRICES_SQL
from tallyforge.schema import COUNTERS, USAGE_EVENTS, from_events
from tallyforge.scratch import new_path
from tallyforge.sources.logs import PROVIDERS
from tallyforge.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: of the table's folder, or of its one file's folder."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return from_events(reader.parquet(path))
    return from_events(reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and return what its sink holds: the last epoch in
    complete mode, all epochs in append mode."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, "stream-out")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/epoch=*")


def carried_to_end(lines: DataFrame, out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream of codex lines over all there is, each batch's events to a folder of its own."""
    spark = lines.sparkSession
    out, state = out or new_path(spark, "stream-out"), state or new_path(spark, "stream-state")

    def sink(events: DataFrame, epoch: int) -> None:
        events.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    live.carry_stream(lines, PROVIDERS["codex"], sink, f"{state}/context", f"{state}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(USAGE_EVENTS).parquet(f"{out}/epoch=*")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(live.stream_buckets(_stream(spark, sf_dir), 21_600, ["model"]), "complete")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stream-latest")
    live.stream_latest(catalog.snapshots(_stream(spark, sf_dir)), path, new_path(spark, "stream-state"), availableNow=True).awaitTermination()
    return live.current(spark, path).select("provider", "message_id", "ts_ms", "model", *COUNTERS)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version of a message that comes to count, with the one whose place it takes."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        rows = finished(live.stream_replaced(catalog.snapshots(_stream(spark, sf_dir)), ttl_ms=None), "append")
    finally:
        spark.conf.set(setting, before)
    return rows.select("provider", "message_id", "ts_ms", "input_tokens", "old_ts_ms", "old_input_tokens")


def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = catalog.price_list(from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
    rows = live.stream_enriched(_stream(spark, sf_dir), prices).select("message_id", "source", F.round("cost", 9).alias("cost"))
    return finished(rows, "append")


def stream_state_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carried_to_end(catalog.codex_lines(_stream(spark, sf_dir)))
    return rows.select("ts_ms", "model", "session_id", "project", *COUNTERS)


for _query in (stream_tumbling, stream_dedup, stream_replaced, stream_enrich, stream_state_model):
    QUERIES[_query.__name__] = _query

SQL["stream_tumbling"] = f"WITH {EVENTS_SQL} SELECT ts_ms // 21600000 * 21600000 AS bucket_ms, model, {ALL_SQL} FROM u GROUP BY ts_ms // 21600000 * 21600000, model"
SQL["stream_dedup"] = f"WITH {EVENTS_SQL} SELECT provider, message_id, ts_ms, model, {COUNTERS_SQL} FROM u"
SQL["stream_replaced"] = f"""WITH {EVENTS_SQL}, v AS (
 SELECT provider, message_id, 1 AS seq, ts_ms, 0 AS input_tokens FROM u WHERE event_id % 10 = 0 UNION ALL SELECT provider, message_id, 2, ts_ms - 5000, 1 FROM u WHERE event_id % 14 = 0
 UNION ALL SELECT provider, message_id, 3, ts_ms - 2000, input_tokens // 3 FROM u WHERE event_id % 4 = 0 UNION ALL SELECT provider, message_id, 4, ts_ms - 1000, input_tokens // 2 FROM u WHERE event_id % 4 = 0
 UNION ALL SELECT provider, message_id, 5, ts_ms, input_tokens FROM u)
SELECT provider, message_id, ts_ms, CAST(input_tokens AS BIGINT) AS input_tokens, lag(ts_ms) OVER w AS old_ts_ms, CAST(lag(input_tokens) OVER w AS BIGINT) AS old_input_tokens
FROM v WINDOW w AS (PARTITION BY provider, message_id ORDER BY seq)"""
SQL["stream_enrich"] = f"WITH {EVENTS_SQL}, {PRICES_SQL} SELECT message_id, session_id AS source, round({COST_SQL}, 9) AS cost FROM u LEFT JOIN p USING (model)"
SQL["stream_state_model"] = f"WITH {EVENTS_SQL} SELECT ts_ms, {catalog._CARRIED} AS model, session_id, project, {COUNTERS_SQL} FROM u"
