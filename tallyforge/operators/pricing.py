"""Prices joined to usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import PRICES, event_cost


def with_prices(df: DataFrame, pricing: DataFrame) -> DataFrame:
    """Left join by exact model name. Nothing runs while the plan is built; Spark broadcasts the
    list once its size is known to be small: from its files (``read_pricing``), or as it runs."""
    return df.join(pricing.select("model", *PRICES.values()), "model", "left")


def with_cost(df: DataFrame, pricing: DataFrame) -> DataFrame:
    """``df`` (model and counters) with ``cost``; null where the model has no price. A positive
    cost that a row already has (of an import) stays."""
    cost = event_cost()
    if "cost" in df.columns:
        cost = F.when(F.col("cost") > 0, F.col("cost")).otherwise(cost)
    return with_prices(df, pricing).withColumn("cost", cost).drop(*PRICES.values())
