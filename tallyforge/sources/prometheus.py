"""Import of Prometheus query responses (vector or matrix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.schema import COUNTERS

RESPONSE = "data struct<result: array<struct<metric: map<string,string>, value: array<string>, values: array<array<string>>>>>"
#: Counters by the series' ``type`` label; other series count as input.
TYPES = {"output": COUNTERS[1], "cache_create": COUNTERS[2], "cache_read": COUNTERS[3]}
#: The exporter's internal label that says which metric a series holds, unless said otherwise.
METRIC_LABEL = "__usage_metric__"


def parse_prometheus(documents: DataFrame, metric_label: str = METRIC_LABEL) -> DataFrame:
    """(model, counters, cost) of response bodies (value): the last sample of each series,
    rounded, routed by its type label; a series without a model is ``(total)``; one whose
    ``metric_label`` is ``cost`` adds to the cost."""
    series = documents.select(F.explode(F.from_json("value", RESPONSE)["data"]["result"]).alias("s"))
    sample = F.coalesce(F.element_at(F.element_at("s.values", -1), 2), F.element_at("s.value", 2)).try_cast("double")
    rows = series.select(
        F.coalesce(F.try_element_at("s.metric", F.lit("model")), F.lit("(total)")).alias("model"),
        F.try_element_at("s.metric", F.lit("type")).alias("type"),
        (F.try_element_at("s.metric", F.lit(metric_label)) == "cost").alias("is_cost"),
        sample.alias("sample"),
    ).where("sample IS NOT NULL")
    is_cost = F.coalesce("is_cost", F.lit(False))

    def total(condition: Column, name: str) -> Column:
        whole = F.round("sample").cast("long")
        return F.coalesce(F.sum(F.when(~is_cost & condition, whole)), F.lit(0)).cast("long").alias(name)

    known = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    return rows.groupBy("model").agg(
        total(~known, COUNTERS[0]),
        *[total(F.col("type") == t, c) for t, c in TYPES.items()],
        F.sum(F.when(is_cost, F.col("sample"))).alias("cost"),
    )


def read_prometheus(spark: SparkSession, path: str, metric_label: str = METRIC_LABEL) -> DataFrame:
    return parse_prometheus(spark.read.text(path, wholetext=True), metric_label)
