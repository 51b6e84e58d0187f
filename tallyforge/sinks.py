"""Outputs: NDJSON, report documents, caller-supplied senders."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from tallyforge.functions.columns import total_tokens
from tallyforge.functions.times import stamp, wall
from tallyforge.schema import COUNTERS
from tallyforge.sources.tail import BLOCK, opened, write_json_lines

log = logging.getLogger(__name__)


def to_ndjson(df: DataFrame) -> DataFrame:
    """One JSON object per row, as column ``value`` for the text sink of batch or stream."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


@dataclass
class Posted(WriterCommitMessage):
    """What one task's calls came to."""

    part: int
    sent: int = 0
    refused: int = 0
    failed: int = 0
    sums: dict[str, int] = field(default_factory=dict)


RECEIPT = "epoch long, part long, sent long, refused long, failed long, sums map<string,long>"


def poster(send: Callable[[list[str]], Sequence[int] | None], name: str = "post") -> type[DataSource]:
    """A data source, for batches and streams, that hands rows as JSON to ``send`` on the executors.

    ``send`` gets up to ``batch`` payloads a call, opens its own connections, sets its own timeout,
    and returns the places of those it refuses, if any. A call that fails is tried ``tries`` times
    in all; its payloads then count as failed, are logged, and the next call follows. Each task
    reports its counts, and sums of the columns in ``sums``, when Spark commits it, so a task that
    runs twice counts once; a batch's reports are written to the folder ``receipts``
    (``read_receipts``), a repeated stream batch over itself. Options: batch, tries, sums, receipts."""

    class Writer(DataSourceStreamArrowWriter):
        def __init__(self, options):
            self.batch, self.tries, self.receipts = int(options.get("batch", 100)), int(options.get("tries", 3)), options.get("receipts")
            self.sums = [c for c in options.get("sums", "").split(",") if c]

        def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
            out = Posted(TaskContext.get().partitionId(), sums=dict.fromkeys(self.sums, 0))
            for rows in iterator:
                for at in range(0, rows.num_rows, self.batch):
                    records = rows.slice(at, self.batch).to_pylist()
                    self._call(records, out)
            return out

        def _call(self, records: list[dict], out: Posted) -> None:
            payloads = [json.dumps(r, default=str) for r in records]
            for left in range(self.tries - 1, -1, -1):
                try:
                    refused = set(send(payloads) or ())
                except Exception as error:  # noqa: BLE001  a sink's failure never stops the stream
                    log.warning("call of %d payloads failed, %d tries left: %s", len(payloads), left, error)
                    continue
                out.sent += len(records) - len(refused)
                out.refused += len(refused)
                for c in self.sums:
                    out.sums[c] += sum(r[c] or 0 for n, r in enumerate(records) if n not in refused)
                return
            out.failed += len(records)

        def commit(self, messages, batchId: int | None = None) -> None:
            if self.receipts:
                rows = [asdict(m) | {"epoch": batchId} for m in messages if m is not None]
                name = uuid.uuid4().hex if batchId is None else batchId
                write_json_lines(f"{self.receipts}/receipt-{name}.json", rows)

        def abort(self, messages, batchId: int | None = None) -> None:
            log.warning("%d tasks of batch %s reported before it was given up", sum(m is not None for m in messages), batchId)

    class Batch(Writer, DataSourceArrowWriter):
        """The same for one batch."""

    class Poster(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite):
            return Batch(self.options)

        def streamWriter(self, schema, overwrite):
            return Writer(self.options)

    return Poster


def post_batch(df: DataFrame, send: Callable[[list[str]], Sequence[int] | None], receipts: str, **options) -> DataFrame:
    """Hand the rows to ``send`` (``poster``); returns the receipts of all batches in that folder."""
    df.sparkSession.dataSource.register(poster(send))
    df.write.format("post").mode("append").options(receipts=receipts, **options).save()
    return read_receipts(df.sparkSession, receipts)


def read_receipts(spark: SparkSession, receipts: str) -> DataFrame:
    return spark.read.schema(RECEIPT).json(f"{receipts}/receipt-*.json")


WEEK = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def report_information(
    events: DataFrame, kind: str, query_since: str | None = None, query_until: str | None = None,
    tz: str | None = None, week_start: int = 0, generated_at: datetime | None = None,
) -> DataFrame:
    """(information): what a report was asked, over which data and when, as one row of JSON."""
    made = (generated_at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def second(ms: str) -> Column:
        return F.concat(stamp(wall(F.timestamp_millis(ms))), F.lit("Z"))

    info = F.struct(
        F.lit(kind).alias("type"), second("first_ms").alias("since"), second("last_ms").alias("until"), F.lit(query_since).cast("string").alias("query_since"),
        F.lit(query_until).cast("string").alias("query_until"), F.lit(tz).cast("string").alias("timezone"), F.lit(WEEK[week_start]).alias("start_of_week"), F.lit(made).alias("generated_at"),
    )
    return events.agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")).select(F.to_json(info, {"ignoreNullFields": "false"}).alias("information"))


def _usage(cost: bool) -> Column:
    """One model's usage under its provider's names; fields of other providers are null, and left out."""
    codex, (i, o, c, r) = F.col("provider") == "codex", (F.col(x) for x in COUNTERS)
    fields = [
        F.col("model"), i.alias("input_tokens"), o.alias("output_tokens"),
        F.when(~codex, c).alias("cache_creation_input_tokens"), F.when(~codex, r).alias("cache_read_input_tokens"),
        F.when(codex, r).alias("cached_input_tokens"), F.when(codex, c).alias("reasoning_output_tokens"),
        total_tokens(F.col("provider")).alias("total_tokens"), F.col("event_count").alias("events"),
    ]
    return F.struct(*fields, *([F.col("cost").alias("cost_usd")] if cost else []))


def report_parts(rows: DataFrame, information: DataFrame, key: str = "period") -> DataFrame:
    """(section, provider, part, at, value): the lines of one report document, to be put in order
    by the first four: its head, each provider's rows between brackets, and its tail.

    ``rows`` are a summary (provider, model, counters, event_count, perhaps cost), by falling count;
    one with the column ``key`` (period, session), whose models make one row for each key, by key;
    or a list (provider, item), by item. No line holds more than one key's models, so a document of
    any length is written as sorted parts."""
    keyed = key in rows.columns
    if "item" in rows.columns:
        made = rows.select("provider", F.struct(F.col("item").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c")).alias("at"), F.to_json(F.struct("item")).alias("_json"))
        made = made.select("provider", "at", F.regexp_extract("_json", r'(?s)^\{"item":(.*)\}$', 1).alias("value"))
    elif keyed:
        one = F.struct((-F.col("event_count")).alias("_order"), F.col("model").alias("_model"), _usage("cost" in rows.columns).alias("entry"))
        models = F.transform(F.sort_array(F.collect_list(one)), lambda x: x.entry)
        grouped = rows.groupBy("provider", key).agg(models.alias("usage_per_models"))
        made = grouped.select("provider", F.struct(F.col(key).alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c")).alias("at"), F.to_json(F.struct(key, "usage_per_models")).alias("value"))
    else:
        made = rows.select("provider", F.struct(F.lit("").alias("a"), (-F.col("event_count")).cast("long").alias("b"), F.col("model").alias("c")).alias("at"), F.to_json(_usage("cost" in rows.columns)).alias("value"))
    first = made.groupBy("provider").agg(F.min("at").alias("_first"))
    comma = F.when(F.col("at") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    body = made.join(first, "provider").select(F.lit(1).alias("section"), "provider", F.lit(1).alias("part"), "at", F.concat(comma, "value").alias("value"))
    none = F.lit(None).cast("struct<a: string, b: bigint, c: string>").alias("at")
    before = F.lag("provider").over(Window.orderBy("provider"))  # of one row for each provider
    edges = first.withColumn("_before", before).select(
        "provider", F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.concat(F.when(F.col("_before").isNull(), F.lit("")).otherwise(F.lit(",")), F.lit('"'), "provider", F.lit('":[')).alias("value")),
            F.struct(F.lit(2).alias("part"), F.lit("]").alias("value")),
        )).alias("e"),
    )
    edges = edges.select(F.lit(1).alias("section"), "provider", "e.part", none, "e.value")
    ends = information.select(F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit('{"information":'), "information", F.lit(',"providers":{')).alias("value")),
        F.struct(F.lit(2).alias("section"), F.lit("}}").alias("value")),
    )).alias("e")).select("e.section", F.lit("").alias("provider"), F.lit(0).alias("part"), none, "e.value")
    return body.unionByName(edges).unionByName(ends)


def write_report(parts: DataFrame, path: str) -> None:
    """The document as text files whose lines, in the order of the files' names, are the document."""
    parts.orderBy("section", "provider", "part", "at").select("value").write.text(path)


def join_files(spark: SparkSession, root: str, parts: Mapping[str, Sequence[tuple[str, int]]], append: bool = False) -> None:
    """Make files below ``root`` of parts (name, bytes) in their order, or ``append`` them to the files.
    In a local or mounted folder each part is copied to its place by a task of its own; in other stores, where a file is written
    from its start to its end, each file is a task (its earlier bytes come first, and the new file takes
    its place when it is whole). Either way a block of bytes is held at a time."""
    system, _, _ = opened(root)
    local, jobs = isinstance(system, fs.LocalFileSystem), []
    for target, own in parts.items():
        at = opened(target)[1]
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        before = system.get_file_info(at).size or 0 if append else 0
        if not local:
            jobs.append((target, before, [*([target] if before else []), *[name for name, _ in own]]))
            continue
        with open(at, "ab" if append else "wb"):  # else an earlier file of this name ends here
            pass
        starts = accumulate([size for _, size in own], initial=before)
        jobs += [(target, start, [name]) for (name, _), start in zip(own, starts)]

    def join(job: tuple[str, int, list[str]]) -> None:
        target, start, names = job
        system, at, _ = opened(target)
        new = at if local or not start else f"{at}.new"
        with open(at, "r+b") if local else system.open_output_stream(new) as out:
            if local and start:
                out.seek(start)
            for name in names:
                with system.open_input_stream(opened(name)[1]) as file:
                    while block := file.read(BLOCK):
                        out.write(block)
        if new != at:
            system.move(new, at)

    if jobs:
        spark.sparkContext.parallelize(jobs, len(jobs)).foreach(join)
