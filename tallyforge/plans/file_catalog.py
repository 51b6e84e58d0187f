"""Registered queries over log files and tables in folders: the events are written as logs of both
providers, and read, ingested, streamed and stored again."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.times import DAY_MS
from tallyforge.operators import dedup, lifecycle, usage as U
from tallyforge.plans import catalog, ingest
from tallyforge.plans.catalog import ALL_SQL, COUNTERS_SQL, EVENTS_SQL, NOW_MS, _CARRIED
from tallyforge.plans.stream_catalog import carried_to_end, finished
from tallyforge.schema import COUNTERS, USAGE_EVENTS, complete, from_events
from tallyforge.scratch import new_path
from tallyforge.sinks import join_files, post_batch, to_ndjson
from tallyforge.sources import lines as L
from tallyforge.sources import logs
from tallyforge.sources.tail import tail
from tallyforge.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Log files that the events are dealt to; every fourth is a sub-agent's.
FILES = 12
#: Events whose lines a task writes.
EVENTS_OF_TASK = 100_000
UUID = "0198aaaa-bbbb-4ccc-8ddd-"
_FILE_SQL = f"user_id % {FILES} AS file"
#: A file's session: its own id, or that of the session it is a sub-agent of (the file before it).
_SESSION_SQL = f"'{UUID}' || lpad('' || (user_id % {FILES} - CASE WHEN user_id % {FILES} % 4 = 3 THEN 1 ELSE 0 END), 12, '0')"
_PROJECT_SQL = f"'p' || (user_id % {FILES} // 4)"


def registered(sql: str):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        SQL[query.__name__] = f"WITH {EVENTS_SQL} {sql if sql.startswith(',') else 'SELECT ' + sql}"
        return query

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _file_number() -> Column:
    return F.regexp_extract("session_id", "([0-9]+)", 1).cast("long") % FILES


def _place(file: int, codex: bool) -> str:
    if codex:
        return f"sessions/2026/rollout-{UUID}{file:012}.jsonl"
    folder, own = f"projects/p{file // 4}", f"{UUID}{file:012}"
    return f"{folder}/{UUID}{file - 1:012}/subagents/agent-{file}.jsonl" if file % 4 == 3 else f"{folder}/{own}.jsonl"


def in_ranges(u: DataFrame, file: Column) -> DataFrame:
    """Events dealt to tasks by ranges of file and line, as many as they need: a file of any size is
    written by many tasks. Only events are shuffled; their lines are made behind it."""
    tasks = max(FILES, -(-u.count() // EVENTS_OF_TASK))
    return u.withColumn("_file", file).repartitionByRange(tasks, "_file", "line_no").drop("_file")


def write_logs(numbered: DataFrame, root: str, codex: bool = False, append: bool = False) -> str:
    """Write lines (value, file, order), dealt by ``in_ranges``, as log files below ``root``, one for
    each file number, each in order, and give them a provider's names; returns ``root``. With ``append``
    the lines go behind those that the files have."""
    spark, made = numbered.sparkSession, f"{root}/made"
    numbered.sortWithinPartitions("file", "order", "value").select("value", "file").write.partitionBy("file").text(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    parts: dict[str, list[tuple[str, int]]] = {}
    for found in files.globStatus(path(f"{made}/file=*/part-*")):
        number = int(found.getPath().getParent().getName().split("=")[1])
        parts.setdefault(f"{root}/{_place(number, codex)}", []).append((found.getPath().toString(), found.getLen()))
    for place, own in parts.items():
        parts[place] = sorted(own, key=lambda part: part[0].rsplit("/", 1)[1])  # tasks are numbered in the order of ranges
    join_files(spark, root, parts, **({"append": True} if append else {}))
    files.delete(path(made), True)
    return root


def claude_logs(u: DataFrame, root: str, append: bool = False) -> str:
    rows = catalog.claude_lines(in_ranges(u, _file_number()).withColumn("project", _file_number().cast("string")))
    file = F.regexp_extract("source_file", "/projects/([0-9]+)/", 1).cast("int")
    return write_logs(rows.select("value", file.alias("file"), F.col("line_no").alias("order")), root, append=append)


def codex_logs(u: DataFrame, root: str, append: bool = False) -> str:
    """Lines of all sessions of a file in the order of events; each event names its session."""
    rows = catalog.codex_lines(in_ranges(u, _file_number()))
    file = F.regexp_extract("source_file", "rollout-s([0-9]+)", 1).cast("int") % FILES
    return write_logs(rows.select("value", file.alias("file"), F.col("line_no").alias("order")), root, codex=True, append=append)


_COLUMNS = ["provider", "message_id", "ts_ms", "model", "session_id", "project", *COUNTERS]
_CLAUDE_ROWS = f"'claude_code' AS provider, message_id, ts_ms, model, {_SESSION_SQL} AS session_id, {_PROJECT_SQL} AS project, {COUNTERS_SQL}"
#: Context is carried along a file, over its sessions.
_CODEX_MODEL = _CARRIED.replace("PARTITION BY user_id", f"PARTITION BY user_id % {FILES}")


@registered(f"{_CLAUDE_ROWS} FROM u")
def claude_files(spark, sf_dir):
    root = claude_logs(_events(spark, sf_dir), new_path(spark, "logs"))
    return logs.read_claude_logs(spark, root).select(_COLUMNS)


@registered(f"session_id || ':' || strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS message_id, ts_ms, {_CODEX_MODEL} AS model, session_id, project, {COUNTERS_SQL} FROM u")
def codex_files(spark, sf_dir):
    root = codex_logs(_events(spark, sf_dir), new_path(spark, "logs"))
    return logs.read_codex_logs(spark, root).select(_COLUMNS[1:])


@registered(f"{_SESSION_SQL} AS session_id, CAST(count(DISTINCT CASE WHEN user_id % {FILES} % 4 = 3 THEN user_id % {FILES} END) AS BIGINT) AS agents, count(DISTINCT CASE WHEN user_id % {FILES} % 4 <> 3 THEN user_id % {FILES} END) AS parents FROM u GROUP BY ALL")
def session_catalogue(spark, sf_dir):
    root = claude_logs(_events(spark, sf_dir), new_path(spark, "logs"))
    found = logs.session_files(spark, root, "claude_code")
    return found.select(
        "session_id", F.size("agents").cast("long").alias("agents"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("parents")
    )


@registered(f"CASE WHEN event_id % 2 = 0 THEN 'claude_code' ELSE 'third' END AS provider, model, {ALL_SQL} FROM u GROUP BY ALL")
def provider_registry(spark, sf_dir):
    """A third provider, registered by a file pattern and a parser, read beside the first."""
    u, number = _events(spark, sf_dir), F.col("message_id").cast("long")
    third = replace(logs.PROVIDERS["claude_code"], name="third", parse=lambda lines: logs.parse_claude(lines).withColumn("provider", F.lit("third")))
    roots = {"claude_code": claude_logs(u.where(number % 2 == 0), new_path(spark, "logs")), "third": claude_logs(u.where(number % 2 == 1), new_path(spark, "logs"))}
    return U.usage(logs.read_logs(spark, roots, logs.PROVIDERS | {"third": third}), by=["provider", "model"])


@registered(
    f", k AS (SELECT *, row_number() OVER (PARTITION BY user_id % {FILES} ORDER BY event_id) AS line_no, {_FILE_SQL} FROM u) SELECT file, line_no, message_id FROM k"
)
def line_numbers(spark, sf_dir):
    u = in_ranges(_events(spark, sf_dir), _file_number())
    root = write_logs(u.select(F.col("message_id").alias("value"), _file_number().alias("file"), F.col("line_no").alias("order")), new_path(spark, "logs"), codex=True)
    rows = L.read_lines(spark, root)
    return rows.select(F.regexp_extract("source_file", r"0*([0-9]+)\.jsonl$", 1).cast("long").alias("file"), "line_no", F.col("value").alias("message_id"))


# Rebuild, ingest, the table


@registered(f"model, {ALL_SQL} FROM u GROUP BY model")
def rebuild_logs(spark, sf_dir):
    root = claude_logs(_events(spark, sf_dir), new_path(spark, "logs"))
    return ingest.rebuild(spark, {"claude_code": root}, new_path(spark, "table"))


@registered(f"{_CLAUDE_ROWS.replace('input_tokens,', 'input_tokens + CASE WHEN event_id % 6 = 0 THEN 5 ELSE 0 END AS input_tokens,', 1)} FROM u")
def ingest_incremental(spark, sf_dir):
    """A table of half the events; then the logs hold all of them, some with a later version, and
    are ingested twice."""
    u, number, root = _events(spark, sf_dir), F.col("message_id").cast("long"), new_path(spark, "logs")
    path = new_path(spark, "table")
    ingest.rebuild(spark, {"claude_code": claude_logs(u.where(number % 2 == 0), f"{root}-1")}, path)
    later = u.where(number % 6 == 0).withColumns({"line_no": F.col("line_no") + 1_000_000_000, "input_tokens": F.col("input_tokens") + 5})
    # A later version of an event has a later time; here a millisecond.
    moved = later.withColumns({"ts_ms": F.col("ts_ms") + 1, "ts": F.timestamp_millis(F.col("ts_ms") + 1)})
    whole = claude_logs(u.unionByName(moved), f"{root}-2")
    for _ in range(2):
        ingest.ingest_changed(spark, {"claude_code": whole}, path, "2000-01-01T00:00:00")
    rows = ingest.read_events(spark, path)
    return rows.withColumn("ts_ms", F.col("ts_ms") - F.when(F.col("message_id").cast("long") % 6 == 0, 1).otherwise(0)).select(_COLUMNS)


@registered(f"provider, message_id, ts_ms, CAST(epoch_ms(ts_ms) AS DATE)::VARCHAR AS day, {COUNTERS_SQL} FROM u")
def stored_events(spark, sf_dir):
    path = new_path(spark, "table")
    ingest.write_events(_events(spark, sf_dir), path)
    return ingest.read_events(spark, path).select("provider", "message_id", "ts_ms", F.col("event_date").cast("string").alias("day"), *COUNTERS)


@registered(f"provider, message_id, ts_ms FROM u WHERE ts_ms >= {NOW_MS - 10 * DAY_MS - 40_000_000}")
def retained_table(spark, sf_dir):
    path = new_path(spark, "table")
    ingest.write_events(_events(spark, sf_dir), path)
    ingest.retain_table(spark, path, NOW_MS - 40_000_000, 10)
    return ingest.read_events(spark, path).select("provider", "message_id", "ts_ms")


def _grown(u: DataFrame, root: str, write: Callable[..., str], part: int, parts: int) -> str:
    """The logs of the first of some parts of the events, in the order of events: each later part
    leaves the lines of the files as they were and adds to them."""
    number = F.col("line_no")  # an event's number, as the scan has it: parts of the table that hold no such events are passed over
    last = u.agg(F.max(number)).first()[0]
    if part == 1:
        return write(u.where(number <= last / parts), root)
    return write(u.where((number > last * (part - 1) / parts) & (number <= last * part / parts)), root, append=True)


@registered(f"{_CLAUDE_ROWS.replace('input_tokens,', 'input_tokens + CASE WHEN event_id % 6 = 0 THEN 5 ELSE 0 END AS input_tokens,', 1)} FROM u")
def ingest_tail(spark, sf_dir):
    """Logs that grow twice, ingested after each step by their new bytes alone; then compacted files
    (a third of the lines has gone, every sixth event has a later version), which are read whole."""
    u, root, path = _events(spark, sf_dir), new_path(spark, "logs"), new_path(spark, "table")
    for part in (1, 2, 3):
        ingest.ingest_tail(spark, {"claude_code": _grown(u, root, claude_logs, part, 3)}, path)
    sixth = F.col("message_id").cast("long") % 6 == 0
    moved = u.withColumns({"input_tokens": F.col("input_tokens") + F.when(sixth, 5).otherwise(0), "ts_ms": F.col("ts_ms") + F.when(sixth, 1).otherwise(0)})
    claude_logs(moved.withColumn("ts", F.timestamp_millis("ts_ms")).where(F.col("message_id").cast("long") % 3 != 1), root)
    for _ in range(2):
        ingest.ingest_tail(spark, {"claude_code": root}, path)
    rows = ingest.read_events(spark, path)
    return rows.withColumn("ts_ms", F.col("ts_ms") - F.when(sixth, 1).otherwise(0)).select(_COLUMNS)


_CODEX_ROWS = f"session_id || ':' || strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS message_id, ts_ms, {_CODEX_MODEL} AS model, session_id, project, {COUNTERS_SQL} FROM u"


@registered(_CODEX_ROWS)
def ingest_tail_context(spark, sf_dir):
    """Growing logs whose lines take their model, session and folder from lines read earlier."""
    u, root, path = _events(spark, sf_dir), new_path(spark, "logs"), new_path(spark, "table")
    for part in (1, 2, 3):
        ingest.ingest_tail(spark, {"codex": _grown(u, root, codex_logs, part, 3)}, path, split_bytes=1 << 16)
    return ingest.read_events(spark, path).select(_COLUMNS[1:])


@registered(_CODEX_ROWS.replace(f"PARTITION BY user_id % {FILES} ", ""))
def one_large_file(spark, sf_dir):
    """One log file with all events, read in splits of 64 KB: context is carried over splits."""
    rows = catalog.codex_lines(in_ranges(_events(spark, sf_dir), F.lit(0)))
    root = write_logs(rows.select("value", F.lit(0).alias("file"), F.col("line_no").alias("order")), new_path(spark, "logs"), codex=True)
    spec = logs.PROVIDERS["codex"]
    return spec.parse(tail(spark, root, spec.file_pattern, spec.needles, split_bytes=1 << 16)).select(_COLUMNS[1:])


_PAGE_SQL = "message_id, ts_ms, CASE WHEN provider = 'codex' THEN input_tokens + output_tokens ELSE input_tokens + output_tokens + cache_creation_input_tokens + cache_read_input_tokens END AS usage_total"


@registered(f"{_PAGE_SQL}, (row_number() OVER (ORDER BY ts_ms, message_id) - 1) // 100 AS page FROM u")
def export_all_pages(spark, sf_dir):
    return lifecycle.export_pages(_events(spark, sf_dir), 100).select("message_id", "ts_ms", "usage_total", "page")


@registered(f"{_PAGE_SQL} FROM u WHERE (ts_ms, message_id) > ({catalog.SINCE_MS}, '') ORDER BY ts_ms, message_id LIMIT 100")
def export_page_early(spark, sf_dir):
    """A page that ends where the rollup beside the table says that it is full."""
    path = new_path(spark, "table")
    ingest.write_events(_events(spark, sf_dir), path)
    ingest.keep_rollup(spark, path)
    page = lifecycle.export_page(ingest.read_events(spark, path), ingest.read_rollup(spark, path), catalog.SINCE_MS, "", 100)
    return page.select("message_id", "ts_ms", "usage_total")


# Streams of files, and sinks


@registered(f"{_CLAUDE_ROWS} FROM u")
def stream_tail(spark, sf_dir):
    """A stream over files that grow between its runs; each run goes on from the last one's offsets."""
    u, root, out, state = _events(spark, sf_dir), new_path(spark, "logs"), new_path(spark, "tail-out"), new_path(spark, "stream-state")
    for part in (1, 2, 3):
        _grown(u, root, claude_logs, part, 3)
        sinks = [lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")]
        live.fan_out(live.tail_usage(spark, root, logs.PROVIDERS["claude_code"]), sinks, state, availableNow=True).awaitTermination()
    return spark.read.schema(USAGE_EVENTS).parquet(f"{out}/epoch=*").select(_COLUMNS)


@registered(_CODEX_ROWS)
def stream_tail_context(spark, sf_dir):
    """The same of logs with context, which outlives batches and runs."""
    u, root, out, state = _events(spark, sf_dir), new_path(spark, "logs"), new_path(spark, "tail-out"), new_path(spark, "stream-state")
    for part in (1, 2, 3):
        _grown(u, root, codex_logs, part, 3)
        rows = carried_to_end(live.tail_usage(spark, root, logs.PROVIDERS["codex"]), out, state)
    return rows.select(_COLUMNS[1:])


@registered(f"{_CLAUDE_ROWS} FROM u")
def stream_claude_files(spark, sf_dir):
    root = claude_logs(_events(spark, sf_dir), new_path(spark, "logs"))
    return finished(live.stream_usage(spark, root, logs.PROVIDERS["claude_code"], 5).select(_COLUMNS), "append")


@registered(f"session_id || ':' || strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS message_id, ts_ms, {_CODEX_MODEL} AS model, session_id, project, {COUNTERS_SQL} FROM u")
def stream_codex_files(spark, sf_dir):
    root = codex_logs(_events(spark, sf_dir), new_path(spark, "logs"))
    return carried_to_end(live.stream_lines(spark, root, 5, logs.CODEX_NEEDLES)).select(_COLUMNS[1:])


@registered("message_id FROM u WHERE event_id % 9 = 0")
def stream_quarantine(spark, sf_dir):
    """Lines whose time does not parse, on a stream."""
    u, number = in_ranges(_events(spark, sf_dir), _file_number()), F.col("message_id").cast("long")
    stamp = F.when(number % 9 == 0, F.concat(F.lit("at "), "message_id")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    value = F.to_json(F.struct(F.col("message_id").alias("id"), stamp.alias("timestamp")))
    root = write_logs(u.select(value.alias("value"), _file_number().alias("file"), F.col("line_no").alias("order")), new_path(spark, "logs"))
    bad = logs.parse_quarantine(live.stream_lines(spark, root))
    return finished(bad.select(F.get_json_object("value", "$.id").alias("message_id")), "append")


@registered("'table' AS sink, message_id, input_tokens FROM u UNION ALL SELECT 'lines', message_id, input_tokens FROM u")
def stream_fan_out(spark, sf_dir):
    root, out = claude_logs(_events(spark, sf_dir), new_path(spark, "logs")), new_path(spark, "fan-out")
    sinks = [
        lambda batch, epoch: batch.select("message_id", "input_tokens").write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}"),
        lambda batch, epoch: to_ndjson(batch.select("message_id", "input_tokens")).write.mode("overwrite").text(f"{out}/lines/epoch={epoch}"),
    ]
    live.fan_out(live.stream_usage(spark, root, logs.PROVIDERS["claude_code"], 5), sinks, new_path(spark, "stream-state"), availableNow=True).awaitTermination()
    table = spark.read.schema("message_id string, input_tokens long").parquet(f"{out}/table/epoch=*")
    lines = spark.read.text(f"{out}/lines/epoch=*").select(F.from_json("value", "message_id string, input_tokens long").alias("r")).select("r.*")
    return table.select(F.lit("table").alias("sink"), "*").unionByName(lines.select(F.lit("lines").alias("sink"), "*"))


@registered("CAST(count(*) AS BIGINT) AS sent, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM u WHERE event_id % 7 <> 0")
def posted_rows(spark, sf_dir):
    """Rows go to a sender on the executors as JSON, several a call; it refuses some. What it took, as
    the tasks' commits say."""

    def send(payloads: list[str]) -> list[int]:
        return [n for n, p in enumerate(payloads) if int(json.loads(p)["message_id"]) % 7 == 0]

    receipts = post_batch(_events(spark, sf_dir).select("message_id", "input_tokens"), send, new_path(spark, "receipts"), sums="input_tokens")
    return receipts.agg(F.sum("sent").alias("sent"), F.sum(F.col("sums")["input_tokens"]).alias("tokens"))


# The rollup beside a table


@registered(
    ", l AS (SELECT * REPLACE (ts_ms + CASE WHEN event_id % 6 = 0 THEN 7200000 ELSE 0 END AS ts_ms, input_tokens + CASE WHEN event_id % 6 = 0 THEN 5 ELSE 0 END AS input_tokens) FROM u) "
    f"SELECT ts_ms // 3600000 * 3600000 AS hour_ms, provider, model, {ALL_SQL} FROM l GROUP BY ALL"
)
def rollup_incremental(spark, sf_dir):
    """A rollup made of half the events and kept by two ingests: new events, and later versions that
    fall two hours later, so that hours lose what was replaced."""
    path, u = _with_rollup(spark, sf_dir)
    return ingest.read_rollup(spark, path).drop("event_date")


def _with_rollup(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    u, number, path = _events(spark, sf_dir), F.col("message_id").cast("long"), new_path(spark, "table")
    ingest.write_events(u.where(number % 2 == 0), path)
    ingest.keep_rollup(spark, path)
    ingest.ingest(spark, u.where(number % 2 == 1), path)
    moved = u.where(number % 6 == 0).withColumns({"ts_ms": F.col("ts_ms") + 7_200_000, "input_tokens": F.col("input_tokens") + 5, "ingest_seq": F.lit(1).cast("long")})
    ingest.ingest(spark, complete(moved.drop("event_key")), path)
    return path, u


@registered(
    ", l AS (SELECT * REPLACE (ts_ms + CASE WHEN event_id % 6 = 0 THEN 7200000 ELSE 0 END AS ts_ms, input_tokens + CASE WHEN event_id % 6 = 0 THEN 5 ELSE 0 END AS input_tokens) FROM u) "
    f"SELECT model, {ALL_SQL} FROM l WHERE ts_ms BETWEEN {catalog.SINCE_MS + 1_020_000} AND {catalog.UNTIL_MS - 980_001} GROUP BY model"
)
def range_from_rollup(spark, sf_dir):
    """A range with ragged ends: whole hours from the rollup, two parts of an hour from events."""
    path, _ = _with_rollup(spark, sf_dir)
    return lifecycle.range_usage(ingest.read_events(spark, path), ingest.read_rollup(spark, path), catalog.SINCE_MS + 1_020_000, catalog.UNTIL_MS - 980_001)


@registered("message_id, model FROM u WHERE event_id % 3 = 0")
def only_new_files(spark, sf_dir):
    """Rows of files that were not stored before, by file and event key."""
    u, number = _events(spark, sf_dir), F.col("message_id").cast("long")
    path = new_path(spark, "table")
    ingest.write_events(u.where(number % 3 != 0), path)
    return dedup.only_new(u, ingest.read_events(spark, path)).select("message_id", "model")
