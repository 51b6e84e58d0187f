"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's rate is the mean number of times each of its documents is to appear: target
characters over the characters it has. The target of a source is its share of the
weights times the corpus; weights are given, or follow a power of the source's size. A
document's count inverts the Poisson distribution at a uniform value hashed from seed and
id, so it does not depend on partitions or on other documents; each document is exploded
by its count and the copies are dealt to partitions and ordered by hashed keys.

Only per-source sums are shuffled before the copies are; a source with a third of all
rows is summed before its shuffle and joined through a table of known size.

Defined cases: null text counts zero characters; a source without characters, or of
weight zero, has rate zero unless all its texts are empty, when it has rate one; null
sources form one source; equal ids get equal counts; a row without an id counts by a hash of its
text, file and number there (of its text alone, where the table is not read from files), so such
rows have counts of their own; rows of one id, or of none, are spread over all tasks; an empty table
stays empty; further columns are carried along, but for one named ``_mix``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, spread_join, table

SEED = 42
#: Largest mean that is inverted at once; a larger one is a sum of equal parts.
LARGEST = 256.0


#: Sources whose rates are broadcast at most; a row has 24 numbers and a few for each unit of the
#: rate, 512 at most.
BROADCAST_SOURCES = 50_000


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null")).alias("_source")


def _uniform(*parts: Column | str) -> Column:
    """52 hashed bits as a double in [0, 1)."""
    bits = F.conv(F.substr(F.md5(F.concat_ws(":", *parts).cast("binary")), F.lit(1), F.lit(13)), 16, 10)
    return bits.cast("long") / F.lit(float(1 << 52))


def _hashed(*parts: Column | str) -> Column:
    """60 hashed bits as a long."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *parts).cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """(source, n_docs, n_chars, rate, parts, cdf) per source of documents (source, text).

    ``weights`` are relative target shares (a source that is not named gets none); without
    them a source weighs its characters to the power ``alpha``."""
    sums = docs.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("long").alias("n_chars"),
    )
    chars = F.col("n_chars").cast("double")
    if weights is None:
        weight = F.sqrt(chars) if alpha == 0.5 else F.pow(chars, F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(name), F.lit(float(w))).otherwise(weight)
    sums = saved(sums.withColumn("weight", F.when(F.col("n_chars") > 0, weight).otherwise(0.0)), "mix-sources")
    total = sums.agg(F.sum("n_chars").alias("c"), F.sum("weight").alias("w")).first()
    whole = F.lit(float(total["c"] or 0))
    rate = F.when(F.col("n_chars") == 0, 1.0).otherwise(F.col("weight") / F.lit(total["w"] or 1.0) * whole / chars)
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc.p * mean / k
        return F.struct(p.alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc.cdf)
    return sums.withColumn("rate", rate).withColumn("parts", parts).withColumn("cdf", cdf)


def _count(seed: int, id_text: Column) -> Column:
    """Smallest k with F(k) above the uniform value, summed over the parts."""
    # First one uniform value for each part, then the table: a hash is made once, not for each entry.
    uniforms = F.transform(F.sequence(F.lit(1), F.col("_rates.parts")), lambda part: _uniform(F.lit(str(seed)), part.cast("string"), id_text))
    return F.aggregate(uniforms, F.lit(0), lambda n, u: n + F.size(F.filter("_rates.cdf", lambda c: c <= u)))


def _tie(docs: DataFrame) -> Column:
    """Hash of a row's text, and of its file and number there if the table is read from files: what
    tells rows of one id, or of none, apart, wherever they are worked on."""
    text = F.col("text").cast("string")
    try:
        at = docs.metadataColumn("_metadata")
        tie = F.xxhash64(text, at["file_path"], at["row_index"])
        docs.select(tie)
    except AnalysisException:
        tie = F.xxhash64(text)
    return tie.alias("_tie")


def _copies(docs: DataFrame, weights: dict[str, float] | None, alpha: float, seed: int, id_col: str) -> DataFrame:
    """The copies in a global random order: (_row, _n, _copy, _key, _rates)."""
    known = rates(docs.select("source", "text"), weights, alpha)
    # One row per source; a null source has a key of its own.
    known = saved(known.select(_source_key(F.col("source")), F.struct("rate", "parts", "cdf").alias("_rates")), "mix-rates")
    rows = docs.select(_source_key(F.col("source")), _tie(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    if known.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(known), "_source", "left")
    else:
        # Hot sources, of which there are few at any size, are broadcast, so that their texts stay
        # where they are; the texts of the others are shuffled.
        joined = spread_join(rows, known, "_source", "mix-sources")
    ids = F.coalesce(F.col("_row")[id_col].cast("string"), F.concat(F.lit("null:"), F.col("_tie").cast("string")))
    counted = joined.withColumn("_n", _count(seed, ids)).where("_n > 0")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    keyed = copies.withColumn("_key", _hashed(F.lit(f"{seed}s"), F.col("_copy").cast("string"), ids))
    # Rows of one id have one key; what tells them apart spreads them.
    return keyed.repartition("_key", "_tie").sortWithinPartitions("_key", "_copy", "_tie")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The copies in a global random order: columns of ``docs`` and a struct ``_mix`` of
    rate, copies, copy (from 1) and shuffle_key. A column of ``docs`` named ``_mix`` is left out."""
    return _copies(docs, weights, alpha, seed, id_col).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c != "_mix"],
        F.struct(
            F.round(F.col("_rates.rate"), 6).alias("rate"), F.col("_n").cast("long").alias("copies"),
            F.col("_copy").cast("long").alias("copy"), F.col("_key").alias("shuffle_key"),
        ).alias("_mix"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed table with the columns of ``docs``, all of them."""
    return _copies(docs, None, 0.5, SEED, "doc_id").select("_row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("length"), "_mix.*")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(length(text), 0) AS len FROM documents),
s AS (SELECT source, CAST(sum(len) AS DOUBLE) AS chars, sqrt(CAST(sum(len) AS DOUBLE)) AS weight FROM d GROUP BY source),
r AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE weight / (SELECT sum(weight) FROM s) * (SELECT sum(chars) FROM s) / chars END AS rate FROM s),
p AS (SELECT source, rate, greatest(ceil(rate / {LARGEST}), 1) AS parts FROM r),
m AS (SELECT *, rate / parts AS mean FROM p),
k AS (SELECT source, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 24) AS BIGINT) + 1)) AS k, mean FROM m),
pmf AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM k),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM pmf),
u AS (SELECT doc_id, d.source, len, rate, CAST('0x' || substr(md5('{SEED}:' || part || ':' || doc_id), 1, 13) AS BIGINT) / {float(1 << 52)} AS u
      FROM (SELECT doc_id, d.source, len, rate, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS part FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source) d),
n AS (SELECT doc_id, u.source, len, rate, u.u, count(*) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.f <= u.u
      GROUP BY doc_id, u.source, len, rate, u.u),
c AS (SELECT doc_id, source, len, rate, CAST(sum(copies) AS BIGINT) AS copies FROM n GROUP BY doc_id, source, len, rate),
x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM c)
SELECT doc_id, source, CAST(len AS BIGINT) AS length, round(rate, 6) AS rate, copies, CAST(copy AS BIGINT) AS copy,
       CAST('0x' || substr(md5('{SEED}s:' || copy || ':' || doc_id), 1, 15) AS BIGINT) AS shuffle_key
FROM x"""
