"""A training corpus from ``documents``: quality rules, SimHash near-dedup, personal data,
mixing, packing. Each stage reads the Parquet table that the one before it wrote.

Defined cases, at every stage: a null text counts as empty, so the quality rules reject it; rows
without an id are judged and packed like others, and stand last where one of a class is chosen;
repeated rows and different texts under one id are rows of their own until near-dedup, which
keeps one of each class and so two of two different texts; a null source is a source; further
columns are carried through all stages but the last, whatever their names; an empty table gives
an empty table. Mixing repeats documents and leaves some out; the ``row_id`` of packed pieces
tells copies apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import mixing, packing, pii, rules, simhash
from tallyforge.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy keeps."""
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out towards the sources' target weights, in random order."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fingerprints, the classifier and token ids are beyond SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
