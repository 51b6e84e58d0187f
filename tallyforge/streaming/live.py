"""Live usage events with Structured Streaming.

Spark's file source (``stream_lines``) takes files that arrive whole and never reads one again
that grew; files that grow are followed by ``sources.tail``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyforge.functions.columns import source_label
from tallyforge.operators.dedup import latest
from tallyforge.operators.pricing import with_cost
from tallyforge.schema import COUNTERS, UNKNOWN, USAGE_EVENTS
from tallyforge.scratch import remove, saved
from tallyforge.sources.context import file_ends
from tallyforge.sources.lines import prefilter
from tallyforge.sources.logs import CONTEXT, ProviderSpec, codex_ends
from tallyforge.sources.tail import tail_stream

DAY_MS = 24 * 3_600_000


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100, needles: Sequence[str] = ()) -> DataFrame:
    """(value, source_file, split, modified, ingest_seq, line_no) of files arriving in a folder:
    lines with one of the needles; ``line_no`` is a place that grows along the file."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", files_per_trigger).text(folder).select("value", "_metadata.*")
    )
    lines = prefilter(lines, needles).select(
        "value", F.col("file_path").alias("source_file"), F.col("file_block_start").alias("split"), F.col("file_modification_time").alias("modified"),
        F.unix_millis("file_modification_time").alias("ingest_seq"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            # As in ``lines._place``, which streams do not allow; places only have to grow.
            places = (batch.column("split").to_numpy(zero_copy_only=False) << 20) + np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield batch.append_column("line_no", pa.array(places, pa.int64()))

    return lines.mapInArrow(number, T.StructType([*lines.schema.fields, T.StructField("line_no", T.LongType())]))


def stream_usage(spark: SparkSession, folder: str, spec: ProviderSpec, files_per_trigger: int = 100) -> DataFrame:
    """Events of files arriving in a folder, of a provider whose lines need no context (of others:
    ``carry_stream``). Lines whose time does not parse are no events; ``parse_quarantine`` gives
    them to another sink."""
    if spec.context:
        raise ValueError(f"lines of {spec.name} take context from lines before them: use carry_stream")
    return spec.parse(stream_lines(spark, folder, files_per_trigger, spec.needles).where(F.col("source_file").rlike(spec.file_pattern)))


def tail_usage(spark: SparkSession, folder: str, spec: ProviderSpec) -> DataFrame:
    """Lines with events of files that arrive and grow in a folder: events, or of a provider whose
    lines take context the lines, for ``carry_stream``."""
    lines = tail_stream(spark, folder, spec.file_pattern, spec.needles)
    return lines if spec.context else spec.parse(lines)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New rows of an event table as a stream."""
    return spark.readStream.schema(USAGE_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def carry_stream(
    lines: DataFrame, spec: ProviderSpec, sink: Callable[[DataFrame, int], None], state: str, checkpoint: str,
    ttl_ms: int | None = DAY_MS, most_files: int | None = None, ends: Callable[[DataFrame], DataFrame] = codex_ends, **trigger,
) -> StreamingQuery:
    """Run a stream of lines (value, source_file, split, line_no, ingest_seq) whose events take
    context from lines before them; each batch's events go to ``sink`` with the batch's number.

    What a file's lines leave to those of later batches is a row of the table ``state``: model,
    session and folder, and when the file was last seen. Within a batch, context is carried
    split by split (``sources.context``): no line is shuffled and no file's lines are held
    together. Rows not seen for ``ttl_ms`` are dropped; beyond ``most_files`` rows the files seen
    last stay, half as many. Batch n reads the state that batch n - 1 left and writes its own, so
    a repeated batch gives the same rows."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _state(spark, state, epoch - 1)
        if "split" not in batch.columns:  # lines of no scan: put together by file, as one split
            batch = batch.withColumn("split", F.lit(0).cast("long")).repartition("source_file").sortWithinPartitions("source_file", "line_no")
        left = saved(ends(batch), "split-ends")
        sink(spec.parse(batch, ends=left, before=before), epoch)
        now_ms = F.unix_millis(F.current_timestamp())
        new = file_ends(left, CONTEXT, before.join(left.select("source_file").distinct(), "source_file", "left_semi")).withColumn("seen_ms", now_ms)
        kept = before.join(new.select("source_file"), "source_file", "left_anti").unionByName(new)
        if ttl_ms is not None:
            kept = kept.where(F.col("seen_ms") >= now_ms - ttl_ms)
        kept = saved(kept, "file-context")
        if most_files is not None and kept.count() > most_files:
            kept = kept.orderBy(F.desc("seen_ms"), "source_file").limit(most_files // 2)
        kept.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        remove(spark, f"{state}/epoch={epoch - 2}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()


STATE = "source_file string, ctx_model string, ctx_session string, ctx_cwd string, seen_ms long"


def _state(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={epoch}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{path}/epoch={epoch}")


def stream_buckets(stream: DataFrame, step_s: int, by: Sequence[str] = ("model",), watermark: str = "1 day") -> DataFrame:
    """Tumbling windows of a stream. In append mode a window shows once the watermark has
    passed it; in complete mode all do."""
    window = F.window("ts", f"{step_s} seconds").alias("w")
    sums = stream.withWatermark("ts", watermark).groupBy(window, *by).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("event_count"))
    return sums.select(F.unix_millis("w.start").alias("bucket_ms"), *by, *COUNTERS, "event_count")


def stream_enriched(stream: DataFrame, pricing: DataFrame) -> DataFrame:
    """Each live event with its cost and source label; the price list is static."""
    return with_cost(stream.withColumn("source", source_label(F.coalesce("source_file", F.lit(UNKNOWN)))), pricing)


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch, held once, to every sink in turn."""

    def each(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, epoch)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()


#: What is kept of a version, and of the one that it replaced (null if the message is new).
VERSION = ("ts_ms", *COUNTERS, "model", "source_file", "ingest_seq", "line_no")
_KINDS = {"model": "string", "source_file": "string"}
CHANGES = "provider string, message_id string, " + ", ".join(f"{p}{c} {_KINDS.get(c, 'long')}" for p in ("", "old_") for c in VERSION)


#: Groups that messages are dealt to: Python is asked once for each group of a batch.
GROUPS = 1 << 14
_NAMES = ("provider", "message_id", *VERSION)
_TS, _FILE, _SEQ, _LINE = (_NAMES.index(c) for c in ("ts_ms", "source_file", "ingest_seq", "line_no"))
#: Versions in one value of the state.
_TOGETHER = 10_000


def _plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows as tuples of plain values; pandas holds whole numbers beside nulls as floats."""
    columns = []
    for name in _NAMES:
        values = frame[name].tolist()
        if frame[name].dtype.kind == "f":
            values = [None if v != v else int(v) for v in values]
        columns.append([None if v is pd.NA else v for v in values])
    return list(zip(*columns))


class Versions(StatefulProcessor):
    """The last version of a message in each file, for a day: which version counts, and when one
    takes the place of another. Versions are ranked as ``dedup.latest`` ranks them.

    A group of messages is one key. Its state is a list of JSON texts, each with the versions that a
    batch added; a version that is no longer its file's last is passed over when they are read."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.added = handle.getListState("versions", "rows string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict[str, tuple]] = {}
        stored = 0
        for (text,) in self.added.get():
            for row in json.loads(text):
                files = held.setdefault((row[0], row[1]), {})
                own = files.get(row[_FILE])
                if own is None or (own[_SEQ], own[_LINE]) < (row[_SEQ], row[_LINE]):
                    files[row[_FILE]] = tuple(row)
                stored += 1
        rank = lambda r: (r[_SEQ], r[_TS], r[_FILE])
        best = {message: max(files.values(), key=rank) for message, files in held.items()}
        new = sorted((r for frame in rows for r in _plain(frame)), key=lambda r: (r[_SEQ], r[_FILE], r[_LINE]))
        out, none, kept = [], (None,) * len(VERSION), {}
        for row in new:
            message, file = row[:2], row[_FILE]
            files, before = held.setdefault(message, {}), best.get(message)
            own = files.get(file)
            if own is not None and (own[_SEQ], own[_LINE]) >= (row[_SEQ], row[_LINE]):
                continue  # seen, or older than what is known of its file
            files[file] = kept[message, file] = row
            if before is None or rank(row) >= rank(before):
                now = row
            else:  # the version that counted may have been this file's
                now = max(files.values(), key=rank) if before[_FILE] == file else before
            best[message] = now
            if now != before:
                out.append((*now, *(before[2:] if before else none)))
        live = sum(map(len, held.values()))
        if self.ttl_ms is None and stored + len(kept) > 2 * live:
            self.added.put(_texts([row for files in held.values() for row in files.values()]))
        elif kept:  # versions with a limit stay as they were written, each with its own time
            self.added.appendList(_texts(list(kept.values())))
        for at in range(0, len(out), _TOGETHER):
            yield pd.DataFrame(out[at : at + _TOGETHER], columns=[*_NAMES, *[f"old_{c}" for c in VERSION]], dtype=object)

    def close(self) -> None:
        pass


def _texts(rows: list[tuple]) -> list[tuple]:
    return [(json.dumps(rows[at : at + _TOGETHER]),) for at in range(0, len(rows), _TOGETHER)]


def stream_replaced(stream: DataFrame, ttl_ms: int | None = DAY_MS, groups: int = GROUPS) -> DataFrame:
    """Changes of a stream of events: each version of a message that comes to count, with the
    version whose place it takes (``old_``; null for a new message). Where the last line of a file
    falls behind another file's version, that one comes to count again.

    A message is forgotten ``ttl_ms`` after its last version of each file; a repeat then is new.
    State is the versions of that time, in RocksDB: the session's state store provider
    (``spark.sql.streaming.stateStore.providerClass``) has to be RocksDB's. Messages are dealt to
    ``groups`` by their hash; a batch reads the state of the groups that it touches, and Python is
    asked once for each of them. The number belongs to the checkpoint. A query with a limit always
    has a next batch, so one that is to end (``availableNow``) has none (None)."""
    rows = stream.select(*_NAMES).where("message_id IS NOT NULL AND source_file IS NOT NULL")
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("provider", "message_id"), F.lit(groups)))
    return dealt.groupBy("group").transformWithStateInPandas(Versions(ttl_ms), CHANGES, "append", "None" if ttl_ms is None else "ProcessingTime")


def stream_latest(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Latest-wins over a stream: each micro-batch, reduced to one version per message, is
    written to a folder of its own epoch, so a repeated epoch overwrites itself. ``current``
    is the table."""

    def each(batch: DataFrame, epoch: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each message over all epochs of ``stream_latest``."""
    return latest(spark.read.option("basePath", path).schema(USAGE_EVENTS).parquet(f"{path}/epoch=*"))
