"""Event tables: full rebuild, incremental ingest, retention in place."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.times import DAY_MS, utc_date
from tallyforge.operators.dedup import latest, only_new
from tallyforge.operators.lifecycle import build_rollup, merge_rollup, retain, rollup_deltas
from tallyforge.operators.usage import usage
from tallyforge.schema import COUNTERS, USAGE_EVENTS
from tallyforge.scratch import remove, saved
from tallyforge.sources.context import file_ends
from tallyforge.sources.logs import CONTEXT, PROVIDERS, ProviderSpec, codex_ends, read_logs, read_provider
from tallyforge.sources.tail import SPLIT, Manifest, file_name, read_manifest, survey, tail, write_manifest, write_plan

PARTITIONS = ("provider", "event_date")
#: Bytes of logs, and of a table's files, whose events are sorted in one task.
LOG_BYTES, TABLE_BYTES = 32 << 20, 4 << 20


def _ordered(df: DataFrame) -> DataFrame:
    # Rebalanced by day: a day makes one file, a busy one as many tasks and files as its size
    # needs, once the sizes are known.
    return df.hint("rebalance", *[F.col(p) for p in PARTITIONS]).sortWithinPartitions(*PARTITIONS, "ts_ms", "message_id")


def write_events(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by provider and day, sorted by time and id within files."""
    writer = _ordered(df).write.mode(mode).partitionBy(*PARTITIONS)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "static")
    writer.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_EVENTS).parquet(path)


def _bytes(spark: SparkSession, path: str) -> int:
    """The size of all files below a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def _tasks(spark: SparkSession, log_bytes: int, table_bytes: int = 0) -> int | None:
    """Partitions for the events of so many bytes, if the session's shuffles have fewer: a task's
    events then do not grow with the logs."""
    wanted = -(-log_bytes // LOG_BYTES) + -(-table_bytes // TABLE_BYTES)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def rebuild(spark: SparkSession, roots: Mapping[str, str], path: str, specs: Mapping[str, ProviderSpec] = PROVIDERS) -> DataFrame:
    """Read all logs, keep the latest version of each message, write the table; returns the
    summary by model, of the table as written."""
    write_events(latest(read_logs(spark, roots, specs), partitions=_tasks(spark, sum(_bytes(spark, root) for root in roots.values()))), path)
    return usage(read_events(spark, path))


def _days_of(days: list) -> Column:
    """Whether a row lies on one of some (provider, day): as a filter that prunes partitions."""
    by_provider: dict[str, list] = {}
    for provider, day in days:
        by_provider.setdefault(provider, []).append(day)
    return reduce(lambda a, b: a | b, [(F.col("provider") == p) & F.col("event_date").isin(list(found)) for p, found in by_provider.items()])


def _partition_path(path: str, provider: str, day: date) -> str:
    return f"{path.rstrip('/')}/provider={provider}/event_date={day}"


def _replace_days(spark: SparkSession, staged: str, path: str, days: list) -> None:
    """Put the folders of days of a table that was written aside in the places of the table's own; of
    ``days``, one that has none there loses its folder. Folders are renamed, so no row is written again;
    an old one is moved aside first, and back if the new one cannot take its place."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files, written = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), set()
    for found in files.globStatus(at(f"{staged}/{PARTITIONS[0]}=*/{PARTITIONS[1]}=*")):
        new = found.getPath()
        provider, name = new.getParent().getName(), new.getName()
        own, aside = at(f"{path.rstrip('/')}/{provider}/{name}"), at(f"{staged}/replaced/{provider}/{name}")
        written.add(own.toString())
        files.mkdirs(own.getParent())
        files.mkdirs(aside.getParent())
        had = files.exists(own)
        if had and not files.rename(own, aside) or not files.rename(new, own):
            if had and not files.exists(own):
                files.rename(aside, own)
            raise OSError(f"{new.toString()} cannot take the place of {own.toString()}")
    for provider, day in days:
        if at(_partition_path(path, provider, day)).toString() not in written:
            remove(spark, _partition_path(path, provider, day))
    spark.catalog.refreshByPath(path)


ROLLUP = f"hour_ms long, provider string, model string, {', '.join(f'{c} long' for c in COUNTERS)}, event_count long, event_date date"


def _rollup_path(path: str) -> str:
    return f"{path.rstrip('/')}-rollup"


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The hourly rollup that is kept beside an event table."""
    return spark.read.schema(ROLLUP).parquet(_rollup_path(path))


def _write_rollup(rollup: DataFrame, path: str, mode: str) -> None:
    dated = rollup.withColumn("event_date", utc_date(F.col("hour_ms")))
    dealt = dated.hint("rebalance", F.col("event_date")).sortWithinPartitions("event_date", "hour_ms")
    dealt.write.mode("overwrite").partitionBy("event_date").option("partitionOverwriteMode", mode).parquet(_rollup_path(path))


def keep_rollup(spark: SparkSession, path: str) -> None:
    """Make the rollup of a table; from then on ``ingest`` keeps it up to date."""
    _write_rollup(build_rollup(read_events(spark, path)), path, "static")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _update_rollup(spark: SparkSession, path: str, deltas: DataFrame, staged: str) -> None:
    """Merge signed differences into the rollup's days that they fall on. The new days are written
    aside first, so a failed write can be repeated; a day without events loses its folder."""
    days = [r.day for r in deltas.select(utc_date(F.col("hour_ms")).alias("day")).distinct().collect()]
    if not days:
        return
    old = read_rollup(spark, path).where(F.col("event_date").isin(days))
    merge_rollup(old, deltas).write.mode("overwrite").parquet(f"{staged}/rollup")
    new = spark.read.parquet(f"{staged}/rollup")
    _write_rollup(new, path, "dynamic")
    left = {r.day for r in new.select(utc_date(F.col("hour_ms")).alias("day")).distinct().collect()}
    for day in set(days) - left:
        remove(spark, f"{_rollup_path(path)}/event_date={day}")


def ingest(spark: SparkSession, batch: DataFrame, path: str, horizon_days: int | None = None, log_bytes: int = 0) -> int:
    """Upsert a batch of parsed events into the table; returns how many rows were new. A rollup that
    is kept beside the table (``keep_rollup``) gets the difference: new rows in, replaced versions
    out, in the hours that changed.

    An event that was stored before has the batch's time, so it is looked for on the batch's days
    alone. Earlier versions of the batch's messages may lie on any day: their keys alone are read,
    of all days, or of the days within ``horizon_days`` of the batch's, if messages are known not
    to change later. A batch that replaces nothing is added to its days as further files, so what it
    costs does not grow with the table. Otherwise the days that new rows or the rows they replace fall
    on are read whole and written aside as a table of the same form, and once all are whole their folders take the
    places of the table's, so a failed write can be repeated; a day that loses its last row loses its folder. Lists of days are gathered at
    the driver, a few bytes for each day. ``log_bytes``: the size of the logs that the batch is read
    from, by which it is dealt to tasks."""
    staged = f"{path.rstrip('/')}-staging/{uuid.uuid4().hex}"
    try:
        return _merge(spark, batch, path, horizon_days, staged, log_bytes)
    finally:
        remove(spark, staged)


def _merge(spark: SparkSession, batch: DataFrame, path: str, horizon_days: int | None, staged: str, log_bytes: int) -> int:
    stored = read_events(spark, path)
    # Versions that a later line of the batch replaces are dropped first: they are not in
    # the table, and would count as new each time their file is parsed again.
    latest(batch, partitions=_tasks(spark, log_bytes)).write.mode("overwrite").parquet(f"{staged}/batch")
    batch = spark.read.schema(USAGE_EVENTS).parquet(f"{staged}/batch")
    own = [tuple(r) for r in batch.select(*PARTITIONS).distinct().collect()]
    if not own:
        return 0
    only_new(batch, stored.where(_days_of(own))).write.mode("overwrite").parquet(f"{staged}/fresh")
    fresh = spark.read.schema(USAGE_EVENTS).parquet(f"{staged}/fresh")
    count = fresh.count()
    if not count:
        return 0
    near = stored
    if horizon_days is not None:
        dates, reach = [day for _, day in own], timedelta(days=horizon_days)
        near = stored.where(F.col("event_date").between(min(dates) - reach, max(dates) + reach))
    ids = fresh.select("provider", "message_id").distinct()
    replaced = near.select(*PARTITIONS, "message_id").join(ids, ["provider", "message_id"], "left_semi")
    lost = {tuple(r) for r in replaced.select(*PARTITIONS).distinct().collect()}
    with_rollup = _exists(spark, _rollup_path(path))
    if not lost:  # nothing to replace: the new rows go beside the others
        if with_rollup:
            rollup_deltas(fresh, fresh.where("false")).write.mode("overwrite").parquet(f"{staged}/deltas")
        write_events(fresh, path, "append")
        if with_rollup:
            _update_rollup(spark, path, spark.read.parquet(f"{staged}/deltas"), staged)
        return count
    days = sorted(lost | {tuple(r) for r in fresh.select(*PARTITIONS).distinct().collect()})
    merged = latest(stored.where(_days_of(days)).unionByName(fresh), partitions=_tasks(spark, 0, _bytes(spark, path) + _bytes(spark, f"{staged}/fresh")))
    write_events(merged, f"{staged}/merged")
    if with_rollup:  # while the table still has the replaced versions
        rollup_deltas(read_events(spark, f"{staged}/merged"), stored.where(_days_of(days))).write.mode("overwrite").parquet(f"{staged}/deltas")
    _replace_days(spark, f"{staged}/merged", path, days)
    if with_rollup:
        _update_rollup(spark, path, spark.read.parquet(f"{staged}/deltas"), staged)
    return count


def ingest_changed(
    spark: SparkSession, roots: Mapping[str, str], path: str, since: str, specs: Mapping[str, ProviderSpec] = PROVIDERS, horizon_days: int | None = None
) -> int:
    """Ingest the files changed after ``since`` (local time of the session, as for Spark's
    ``modifiedAfter``). A changed file is parsed whole and its known events are left out,
    so appended, compacted and rewritten files need no special case and a repeat is harmless."""
    batches = [read_provider(spark, root, specs[name], modified_after=since) for name, root in roots.items()]
    return ingest(spark, reduce(DataFrame.unionByName, batches), path, horizon_days, sum(_bytes(spark, root) for root in roots.values()))


def _offsets(path: str, name: str) -> str:
    return f"{path.rstrip('/')}-offsets/{name}"


def ingest_tail(
    spark: SparkSession, roots: Mapping[str, str], path: str, specs: Mapping[str, ProviderSpec] = PROVIDERS,
    horizon_days: int | None = None, split_bytes: int = SPLIT,
) -> int:
    """Ingest what is new in growing logs: of each file the bytes behind the last line that was read,
    or the whole file if that line has gone (``sources.tail``). Returns how many events were new.

    How far files have been read is kept beside the table, by provider, and replaced only once the
    events are stored: a failed run is repeated from where the last one ended, and events that it
    had stored are left out. Lines that take context from lines before them get what the last
    reading of their file left. The table is made if it does not exist."""
    batches, manifests, size = [], {}, 0
    for name, root in roots.items():
        spec = specs[name]
        known = read_manifest(f"{_offsets(path, name)}.jsonl")
        marks, ranges = survey(root, spec.file_pattern, known.marks)
        manifest = Manifest(marks, {r.path: r.end - r.start for r in ranges}, {p: c for p, c in known.context.items() if p in marks})
        manifests[name] = manifest
        size += sum(r.end - r.start for r in ranges)
        if not ranges:
            continue
        lines = tail(spark, root, spec.file_pattern, spec.needles, write_plan(f"{_offsets(path, name)}.plan", ranges), split_bytes)
        if not spec.context:
            batches.append(spec.parse(lines))
            continue
        names = {file_name(root, r.path): r.path for r in ranges}
        left = [(file_name(root, r.path), *[known.context[r.path].get(c) for c in CONTEXT]) for r in ranges if r.start and r.path in known.context]
        before = spark.createDataFrame(left, "source_file string, " + ", ".join(f"{c} string" for c in CONTEXT))
        ends = saved(codex_ends(lines), "split-ends")
        batches.append(spec.parse(lines, ends=ends, before=before))
        # A row for each file that was read, like the marks themselves.
        for r in file_ends(ends, CONTEXT, before).collect():
            manifest.context[names[r.source_file]] = {c: r[c] for c in CONTEXT if r[c] is not None}
    count = 0
    if batches:
        batch = reduce(DataFrame.unionByName, batches)
        if _exists(spark, path):
            count = ingest(spark, batch, path, horizon_days, size)
        else:
            write_events(latest(batch, partitions=_tasks(spark, size)), path)
            count = read_events(spark, path).count()
    for name, manifest in manifests.items():
        write_manifest(f"{_offsets(path, name)}.jsonl", manifest)
    return count


def retain_table(spark: SparkSession, path: str, now_ms: int, days: int) -> None:
    """Apply retention to the table: folders of days before the boundary's day are removed, and
    the boundary's day is rewritten from a copy made first."""
    if not days:
        return
    boundary = datetime.fromtimestamp((now_ms - days * DAY_MS) / 1000, timezone.utc).date()
    staged = f"{path.rstrip('/')}-staging/{uuid.uuid4().hex}"
    on_boundary = read_events(spark, path).where(F.col("event_date") == F.lit(boundary))
    retain(on_boundary, now_ms, days).write.mode("overwrite").parquet(staged)
    kept = spark.read.schema(USAGE_EVENTS).parquet(staged)
    _ordered(kept).write.mode("overwrite").partitionBy(*PARTITIONS).option("partitionOverwriteMode", "dynamic").parquet(path)
    left = {r.provider for r in kept.select("provider").distinct().collect()}
    remove(spark, staged)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/provider=*/event_date=*")
    for found in files.globStatus(pattern):
        folder = found.getPath()
        provider, day = (folder.getParent().getName().split("=", 1)[1], date.fromisoformat(folder.getName().split("=", 1)[1]))
        if day < boundary or day == boundary and provider not in left:
            files.delete(folder, True)
