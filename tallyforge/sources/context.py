"""Context that lines take from lines before them, by a prefix scan over the splits of a file.

Each split leaves its last values (a row for each split); a window over these few rows gives what
holds before each split; lines are filled within their split while they are read, and take the
rest from that table. No line is shuffled, and a task holds one split's lines at most a batch at a
time, so one file of any size is spread over all its splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.scratch import saved


def filled(rows: DataFrame, names: Sequence[str], by: str = "source_file", split: str = "split") -> DataFrame:
    """Each named column's last value so far within its split. A split's rows must stand together
    and in order in their task, as they do when they come from a scan."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, [pa.scalar(None)] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file = batch.column(columns.index(by)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start = batch.column(columns.index(split)).to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], (file[1:] != file[:-1]) | (start[1:] != start[:-1])))
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            key = (batch.column(columns.index(by))[0].as_py(), int(start[0]))
            goes_on = key == last_key
            out = list(batch.columns)
            for k, name in enumerate(names):
                own = batch.column(columns.index(name))
                at = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                before = at < head  # nothing in this split so far
                values = own.take(pa.array(np.where(before, 0, at), mask=before))
                if goes_on and last[k].is_valid:
                    # The split goes on from the last batch, and so does its value.
                    carried = before & (head == 0)
                    values = pc.if_else(pa.array(carried), pa.scalar(last[k].as_py(), own.type), values)
                last[k] = values[n - 1]
                out[columns.index(name)] = values
            last_key = (batch.column(columns.index(by))[n - 1].as_py(), int(start[n - 1]))
            yield pa.record_batch(out, names=columns)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]))


def split_ends(rows: DataFrame, names: Sequence[str], by: str = "source_file", split: str = "split", order: str = "line_no") -> DataFrame:
    """(by, split, names): the last value of each column in each split; combined before the shuffle."""
    last = [F.max(F.when(F.col(n).isNotNull(), F.struct(F.col(order), F.col(n))))[n].alias(n) for n in names]
    return rows.groupBy(by, split).agg(*last)


def carried(
    rows: DataFrame, names: Sequence[str], ends: DataFrame, before: DataFrame | None = None, by: str = "source_file", split: str = "split"
) -> DataFrame:
    """``rows`` with each named column's last value so far in its file.

    ``ends``: ``split_ends`` of all splits, as a table. ``before`` (by, names): what held before
    the first split of a file."""
    if before is not None:
        first = before.select(by, F.lit(-1).cast("long").alias(split), *names)
        ends = ends.unionByName(first)
    so_far = Window.partitionBy(by).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    prefix = ends.select(by, split, *[F.last(n, ignorenulls=True).over(so_far).alias(f"_{n}") for n in names])
    # A row for each split, written: Spark sends it to all tasks while it is small.
    prefix = saved(prefix.where(" OR ".join(f"_{n} IS NOT NULL" for n in names)), "split-context")
    local = filled(rows, names, by, split)
    met = local.join(prefix, [by, split], "left")
    return met.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in names else F.col(c) for c in rows.columns])


def file_ends(ends: DataFrame, names: Sequence[str], before: DataFrame | None = None, by: str = "source_file", split: str = "split") -> DataFrame:
    """(by, names): what each file leaves to lines after its last one."""
    if before is not None:
        ends = ends.unionByName(before.select(by, F.lit(-1).cast("long").alias(split), *names))
    last = [F.max(F.when(F.col(n).isNotNull(), F.struct(F.col(split), F.col(n))))[n].alias(n) for n in names]
    return ends.groupBy(by).agg(*last)


def numbered(rows: DataFrame, by: str = "source_file", split: str = "split") -> DataFrame:
    """``line_no`` from 1 along each file, for all its lines as they come from a scan: numbers
    within splits, and running counts of the splits before them."""

    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, start = batch.column(columns.index(by)), batch.column(columns.index(split)).to_numpy(zero_copy_only=False)
            file = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.concatenate(([False], (file[1:] != file[:-1]) | (start[1:] != start[:-1])))
            if (files[0].as_py(), int(start[0])) != last_key:
                count = 0
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place = np.arange(1, n + 1) - head + np.where(head == 0, count, 0)
            last_key, count = (files[n - 1].as_py(), int(start[n - 1])), int(place[-1])
            yield pa.record_batch([*batch.columns, pa.array(place, pa.int64())], names=[*columns, "_n"])

    local = rows.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], T.StructField("_n", T.LongType())]))
    before = Window.partitionBy(by).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, split).agg(F.count("*").alias("_lines"))
    base = saved(counts.select(by, split, F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_base")), "split-lines")
    return local.join(base, [by, split]).withColumn("line_no", F.col("_base") + F.col("_n")).drop("_base", "_n")
