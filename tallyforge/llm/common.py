"""Helpers that several operators share: table reads, bounded samples, a join that hot keys
do not slow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.scratch import new_path, saved

__all__ = ["least_hashed", "likely_least", "new_path", "saved", "spread_join", "table"]

#: Rows from which a key counts as hot, at least, and hot keys that a table can have at most.
HOT_ROWS, HOT_KEYS = 1_000, 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def likely_least(hashed: Column, wanted: int, count: Column) -> Column:
    """Whether a 64-bit hash is surely enough among the ``wanted`` least of ``count`` hashes: four
    times as many pass, on average. In double precision, so that no share is rounded to nothing
    below 2^50 rows; it spares ``least_hashed`` the sorting of what can't be picked."""
    return hashed.cast("double") <= F.lit(-(2.0**63)) + F.least(F.lit(1.0), 4.0 * wanted / count.cast("double")) * F.lit(2.0**64)


def least_hashed(rows: DataFrame, by: str, wanted: int, *order: str) -> DataFrame:
    """The ``wanted`` first rows of each ``by`` in the given order; every task drops the others
    of its own rows before the shuffle."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_first", first).where(F.col("_first") <= wanted).drop("_first")


def spread_join(large: DataFrame, small: DataFrame, key: str, name: str, how: str = "left") -> DataFrame:
    """Join (left or inner) to a table with one row per key, whatever the keys' sizes in ``large``.

    Keys of more than 1 in HOT_KEYS of all rows (and more than HOT_ROWS) are hot: at most
    HOT_KEYS of them exist, so their rows of ``small`` are broadcast and their rows of ``large``
    stay where they are. The others meet by shuffle; null keys meet nothing. ``large`` is read
    three times and should be a table, not a long plan."""
    keyed = large.where(F.col(key).isNotNull())
    counts = keyed.groupBy(key).agg(F.count("*").alias("_n"))
    most = max(HOT_ROWS, large.count() // HOT_KEYS)
    hot = saved(counts.where(F.col("_n") > most).select(key), f"{name}-hot")
    if hot.isEmpty():
        found = keyed.join(small, key, how)
    else:
        few = saved(small.join(F.broadcast(hot), key, "left_semi"), f"{name}-few")
        found = keyed.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
        rest = keyed.join(F.broadcast(hot), key, "left_anti").join(small.join(F.broadcast(hot), key, "left_anti"), key, how)
        found = found.unionByName(rest)
    if how == "inner":
        return found
    return found.unionByName(large.where(F.col(key).isNull()), allowMissingColumns=True)
