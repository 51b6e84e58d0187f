from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import common, mixing

SCHEMA = "doc_id long, source string, text string, copy long"


def test_counts_follow_the_rates(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"),
        F.lit("0123456789").alias("text"), F.lit(7).cast("long").alias("copy"),
    )
    out = mixing.mix(docs, weights={"a": 3, "b": 1})
    assert out.columns == [*docs.columns, "_mix"]
    n = Counter(r.source for r in out.collect())
    # a: 15,000 of 5,000 documents (rate 3), b: 5,000 of 15,000 (rate 1/3)
    assert abs(n["a"] - 15_000) < 500 and abs(n["b"] - 5_000) < 300
    zero = out.where("source = 'a'").select("doc_id").distinct().count()
    assert abs(5_000 - zero - 5_000 * 2.718281828**-3) < 60


def test_large_rates_are_sums(spark):
    docs = spark.createDataFrame([(i, "a", "x", 0) for i in range(40)] + [(99, "b", "y" * 80_000, 0)], SCHEMA)
    out = mixing.mix(docs, weights={"a": 1, "b": 0})
    n = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert 99 not in n and len(n) == 40
    mean = sum(n.values()) / 40
    assert abs(mean - 80_040 / 40) < 40  # three deviations of a mean of forty


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "t", None), (1, None, "t", None), (None, None, None, None), (2, "e", "", 1), (3, "e", None, 1)], SCHEMA)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = Counter(tuple(r) for r in out.collect())
    assert counts[(1, None, "t", None)] % 2 == 0
    assert set(counts) <= {tuple(r) for r in docs.collect()}
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_same_counts_however_partitioned(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("abc").alias("text"), F.lit(1).alias("copy"))
    one = mixing.mix(docs.coalesce(1)).select("doc_id", "_mix.copy", "_mix.shuffle_key")
    many = mixing.mix(docs.repartition(7)).select("doc_id", "_mix.copy", "_mix.shuffle_key")
    assert sorted(one.collect()) == sorted(many.collect())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "s", "some text", 5, 6, 7) for i in range(50)], "doc_id long, source string, text string, _mix int, _row int, _source int")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "text", "_row", "_source", "_mix"] and out.select("_mix.copy").count() > 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and {(r._mix, r._row, r._source) for r in kept.collect()} == {(5, 6, 7)}


def test_many_sources_and_a_hot_one(spark, monkeypatch):
    """Beyond the broadcast bound the rows are the same, a source with a third of them included."""
    docs = spark.createDataFrame([(i, None if i % 50 == 1 else "hot" if i % 3 == 0 else f"s{i % 97}", f"text {i}") for i in range(900)], "doc_id long, source string, text string")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_rows_without_an_id_are_spread_and_count_apart(spark, tmp_path):
    """A third of the rows has no id, another third one id; half of the texts are alike."""
    docs = spark.range(0, 12_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(-1)).cast("long").alias("doc_id"), F.lit("s").alias("source"),
        F.when(F.col("id") % 2 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id") + 100_000)).alias("text"),
    )
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mixing.mix(docs, weights={"s": 1})
        sizes = sorted(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        none = out.where("doc_id IS NULL")
        counts = Counter(r.n for r in none.where("text <> 'the same text'").groupBy("text").agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 40 and sizes[-1] <= 3 * sizes[20]
    # Rate one: of rows without an id a third is left out, a third stays once, the others come again.
    assert 0.55 < sum(counts.values()) / 2_000 < 0.71 and 0.3 < counts[1] / 2_000 < 0.44 and counts[2] > 250
    alike = none.where("text = 'the same text'").count()
    assert 1_800 < alike < 2_200
