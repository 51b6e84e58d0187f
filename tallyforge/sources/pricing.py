"""Price lists: a JSON object of model names and per-token prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.columns import PRICES
from tallyforge.scratch import saved

#: Providers whose prices are kept.
VENDORS = ("anthropic", "openai", "gemini")
ENTRY = "struct<litellm_provider: string, " + ", ".join(f"{p}: double" for p in PRICES.values()) + ">"


def parse_pricing(documents: DataFrame) -> DataFrame:
    """(model, four prices) of documents (value). Entries need both main prices and one
    above zero. A name is what follows its last slash; of two entries with one name, the
    one that had no prefix counts, then the smallest key."""
    entries = documents.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("key", "e"))
    cost_in, cost_out = F.col("e.input_cost_per_token"), F.col("e.output_cost_per_token")
    kept = entries.where(F.col("e.litellm_provider").isin(*VENDORS)).where((cost_in > 0) | (cost_out > 0)).where(cost_in.isNotNull() & cost_out.isNotNull())
    named = kept.select(F.substring_index("key", "/", -1).alias("model"), "key", "e.*").drop("litellm_provider")
    first = Window.partitionBy("model").orderBy(F.col("key") != F.col("model"), "key")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "key")


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """The list of a file, parsed once and kept as a table, so that its size is known to joins."""
    return saved(parse_pricing(spark.read.text(path, wholetext=True)), "prices")
