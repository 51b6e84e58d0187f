"""Log lines as DataFrames: text scans, line numbers, carry-forward of context."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.context import numbered as numbered_lines


def read_lines(spark: SparkSession, root: str, needles: Sequence[str] = (), modified_after: str | None = None, numbered: bool = True) -> DataFrame:
    """(value, source_file, split, modified, line_no) of every ``*.jsonl`` below ``root``. Lines
    without any of the needles are dropped before JSON is parsed; their numbers stay.

    ``split`` is where a line's split of the file starts. Without ``numbered``, ``line_no`` is a
    place that grows along the file, made while it is read; with it, lines count from 1 along
    each file. Either way no line is shuffled."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    text = reader.text(root).select("value", "_metadata.*")
    named = [F.col("file_path").alias("source_file"), F.col("file_block_start").alias("split"), F.col("file_modification_time").alias("modified")]
    lines = text.select("value", *named, *([] if numbered else [_place().alias("line_no")]))
    return prefilter(with_line_no(lines) if numbered else lines, needles)


def _place() -> Column:
    """A number that grows along a file: the start of the split, then the row in the task.

    Splits of a file start at least 2^13 bytes apart, and a task numbers its rows below 2^33,
    so the two can be added with the start moved by 20 bits."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(F.col("file_block_start"), 20) + row


def with_line_no(lines: DataFrame) -> DataFrame:
    """``line_no`` from 1 within each file of lines as a scan gives them (source_file, split)."""
    return numbered_lines(lines)


def prefilter(df: DataFrame, needles: Sequence[str]) -> DataFrame:
    if not needles:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.col("value").contains(n) for n in needles]))


def drop_torn(df: DataFrame) -> DataFrame:
    """Without lines that are not one complete JSON object, such as a torn last line. The log
    parsers drop them by themselves; this is for lines that are kept as text."""
    return df.where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())


def carry_forward(df: DataFrame, names: Sequence[str], by: str = "source_file", order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Each named column's last value so far within its file."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in names})
