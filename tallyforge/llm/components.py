"""Connected components of a link table, in rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.llm import common
from tallyforge.llm.common import saved

MAX_ROUNDS = 60


def _noted(df: DataFrame, name: str, *notes: Column) -> tuple[DataFrame, dict]:
    """``df`` saved, and aggregates of its rows taken while it is written."""
    seen = Observation()
    out = saved(df.observe(seen, *notes), name)
    return out, seen.get


def _stars(links: DataFrame, count: int, large: bool, name: str) -> DataFrame:
    """One star step over ``count`` links (a, b), a > b, both directions used.

    Large star: every larger neighbour of a node is linked to the node's smallest
    neighbour. Small star: every smaller neighbour, and the node, is. Smallest neighbours
    come from an aggregation that combines before its shuffle. Nodes of more than 1 in
    HOT_KEYS of the links are at most 2 x HOT_KEYS; they are broadcast to their links, so a
    node with a third of all links is spread over all tasks."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    least, seen = _noted(least, f"{name}-least", F.max("n").alias("most"))
    most = max(common.HOT_ROWS, count // common.HOT_KEYS)
    if (seen["most"] or 0) > most:
        hot = least.where(F.col("n") > most).select("u", "m")
        met = both.join(F.broadcast(hot), "u").unionByName(
            both.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
        )
    else:
        met = both.join(least.select("u", "m"), "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest node.

    ``links`` has two bigint columns a and b in any order. Large and small star steps
    alternate (Kiveris et al., 2014) until nothing moves; each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round."""
    marks = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = _noted(ordered.where("a > b").distinct(), name, *marks)
    for _ in range(MAX_ROUNDS):
        if not before["n"]:
            break
        wide, mark = _noted(_stars(now, before["n"], True, name), name, *marks)
        now, mark = _noted(_stars(wide, mark["n"], False, name), name, *marks)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
    )
