"""Token ids in a content-addressed store.

Layout of a store folder (Parquet, written by Spark's committers):

- ``chunks``: one row per distinct chunk - its id (BLAKE2b, 16 bytes, of the ids as
  little-endian unsigned 32-bit integers), its number of ids and the ids as little-endian
  unsigned 16-bit integers.
- ``recipes``: one row per document in ascending id order, cut into parts by range -
  part, doc_id, row (its place in the part), start within the part, n_tokens and the ids
  of its chunks in order.
- ``manifest``: one row per part - its rows, its ids, the ids of all parts before it, and
  the Merkle root over its documents (id, number of ids, chunk ids), which ``read`` checks.

A rolling hash over the last ROLL ids cuts a document's ids where its low bits are zero,
so equal passages give equal chunks wherever they stand. Each chunk is stored once.

Reading back takes each stored chunk once: the ids are hashed again (they must give the
chunk's id) and check-summed, and a document's checksum is combined from those of its
chunks in recipe order, so the ids of a chunk that a third of all documents share are not
sent once for each of them. ``reconstruct`` joins the ids themselves for given documents.

Defined cases: a null or empty text is its end id alone; null ids sort first; repeated ids
are told apart by their checksums and all stay; an empty table gives an empty store;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import new_path, saved, spread_join, table
from tallyforge.llm.packing import shifted
from tallyforge.llm.tokens import WORD_BPE, encoder, tokenizer_path
from tallyforge.scratch import remove

END_ID = 1
ROLL = 16
#: A cut where the low bits of the rolling hash are zero: one place in 512.
CUT_MASK = np.uint64(511 << 40)
LEAST, MOST = 64, 4096
#: Children of a node of the Merkle trees.
FAN = 256
ID_BYTES = 16
STAGED = "doc_id long, n_tokens long, tie long, chunk_ids binary, chunk_id binary, n_ids int, payload binary"


def places(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash allows a cut: mixed values of the last ROLL ids, summed modulo
    2^64 (a running sum less the one ROLL places before) and mixed once more. Chunks have at
    least LEAST ids, more than ROLL, so texts may stand one after the other in ``ids``."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.cumsum(mixed, dtype=np.uint64)
    total[ROLL:] -= total[:-ROLL].copy()
    total *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((total & CUT_MASK) == 0) + 1


def cuts(begin: int, n: int, allowed: list[int]) -> list[int]:
    """Ends of the chunks of one document's ids, which start at ``begin``, given the places
    where a cut is allowed; chunks have LEAST to MOST ids but the last."""
    ends, start, n = [], begin, begin + n
    for place in [*allowed, n]:
        while place - start > MOST:
            start += MOST
            ends.append(start)
        if place - start >= LEAST and place < n:
            ends.append(place)
            start = place
    if start < n:
        ends.append(n)
    return ends


def chunk_id(ids: bytes | memoryview) -> bytes:
    return hashlib.blake2b(ids, digest_size=ID_BYTES).digest()


def _staged(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """A recipe row per document and, between them, a row for each chunk that the task
    has not sent before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent = encoder(path, True).encode, set()
        for batch in batches:
            rows: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for first, ids, ends in encode(batch.column(1), END_ID):
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("the store keeps ids of 16 bits; this vocabulary has larger ones")
                wide, narrow = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype("<u2").tobytes())
                at, begin = places(ids), 0
                limits = np.searchsorted(at, ends).tolist()
                at, low = at.tolist(), 0
                for doc, end, high in zip(docs[first:], ends.tolist(), limits):
                    names, start = [], begin
                    for stop in cuts(begin, end - begin, at[low:high]):
                        name = chunk_id(wide[4 * start : 4 * stop])
                        names.append(name)
                        if name not in sent:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(name)
                            rows.append((None, None, None, None, name, stop - start, bytes(narrow[2 * start : 2 * stop])))
                        start = stop
                    joined = b"".join(names)
                    rows.append((doc, end - begin, zlib.crc32(joined), joined, None, None, None))
                    begin, low = end, high
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in STAGED.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, STAGED)


def _manifest(recipes: DataFrame) -> DataFrame:
    """(part, rows, ids, root) of each part: the Merkle root over its documents in order, with
    up to FAN children to a node. Only hashes are shuffled, and no group holds more than FAN of
    them but the roots of parts beyond FAN^3 documents."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    leaf = F.sha2(F.concat_ws(":", doc, "n_tokens", F.hex("chunk_ids")).cast("binary"), 256)
    nodes = recipes.select("part", F.col("row").cast("long").alias("at"), leaf.alias("node"), F.lit(1).cast("long").alias("rows"), F.col("n_tokens").alias("ids"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x.node), "")
    sums = [F.sha2(joined.cast("binary"), 256).alias("node"), F.sum("rows").alias("rows"), F.sum("ids").alias("ids")]
    for _ in range(2):
        nodes = nodes.groupBy("part", F.floor(F.col("at") / FAN).alias("above")).agg(*sums).withColumnRenamed("above", "at")
    return nodes.groupBy("part").agg(*sums).select("part", "rows", "ids", F.col("node").alias("root"))


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids ``before`` each part: one row per part, that is per task of the
    range partitioning, far fewer than documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' ids as a store in ``folder``."""
    spark, path = docs.sparkSession, path or tokenizer_path(WORD_BPE)
    staging = f"{folder}/staging"
    _staged(docs, path, id_col, text_col).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    chunks = staged.where("chunk_id IS NOT NULL").select("chunk_id", "n_ids", "payload").dropDuplicates(["chunk_id"])
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    documents = staged.where("chunk_ids IS NOT NULL").select("doc_id", "n_tokens", "tie", "chunk_ids")
    ordered = documents.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{folder}/ordered")
    parts = spark.read.parquet(f"{folder}/ordered")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    recipes = parts.select(
        "part", "doc_id", F.row_number().over(within).alias("row"),
        (F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("start"),
        "n_tokens", "chunk_ids",
    )
    recipes.write.parquet(f"{folder}/recipes")
    _placed(_manifest(spark.read.parquet(f"{folder}/recipes"))).write.parquet(f"{folder}/manifest")
    for spare in ("staging", "ordered"):
        remove(spark, f"{folder}/{spare}")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, n, crc) of stored chunks; raises where the ids do not give the chunk's id."""
    for batch in batches:
        names, sizes, crcs = batch.column(0).to_pylist(), [], []
        for name, payload in zip(names, batch.column(1).to_pylist()):
            ids = np.frombuffer(payload, dtype="<u2").astype("<u4").tobytes()
            if chunk_id(ids) != name:
                raise ValueError(f"stored chunk {name.hex()} does not hold its ids")
            sizes.append(len(ids) // 4)
            crcs.append(zlib.crc32(ids))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["chunk_id", "n", "crc"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksum and number of ids of each document from those of its chunks."""
    for batch in batches:
        sizes, crcs = [], []
        for chunks in batch.column("chunks").to_pylist():
            n = crc = 0
            for chunk in sorted(chunks, key=lambda c: c["seq"]):
                crc = shifted(crc, 4 * chunk["n"]) ^ chunk["crc"]
                n += chunk["n"]
            sizes.append(n)
            crcs.append(crc)
        keys = [batch.column(c) for c in ("part", "row")]
        yield pa.record_batch([*keys, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "row", "n", "crc"])


def _references(recipes: DataFrame) -> DataFrame:
    """(part, row, seq, chunk_id): the chunks of each recipe."""
    count = (F.length("chunk_ids") / ID_BYTES).cast("int")
    each = recipes.select("part", "row", "chunk_ids", F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    return each.select("part", "row", "seq", F.expr(f"substr(chunk_ids, seq * {ID_BYTES} + 1, {ID_BYTES})").alias("chunk_id"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a store.

    The recipes must give the roots of the manifest first: a recipe that was changed, moved or
    lost, or a changed manifest, is an error here. Chunks prove themselves while they are read."""
    bad = [r.part for r in verify(spark, folder).orderBy("part").take(5)]
    if bad:
        raise ValueError(f"recipes do not give the manifest's roots in parts {bad} of {folder}")
    recipes, manifest = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/manifest")
    # Written, so that each stored chunk is read and hashed once, hot chunks or not.
    chunks = spark.read.parquet(f"{folder}/chunks").select("chunk_id", "payload")
    stored = saved(chunks.mapInArrow(_checked, "chunk_id binary, n long, crc long"), "store-checked")
    found = spread_join(_references(recipes), stored, "chunk_id", "store-chunks", "inner")
    whole = found.groupBy("part", "row").agg(F.collect_list(F.struct("seq", "n", "crc")).alias("chunks"))
    sums = whole.mapInArrow(_combined, "part int, row int, n long, crc long")
    light = recipes.select("part", "row", "doc_id", "start", "n_tokens")
    rows = light.join(sums, ["part", "row"], "left").join(manifest.select("part", "before"), "part")
    # A document whose chunks are not all there, or do not add up, is an error, not a row.
    held = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a recipe's chunks are missing")).cast("long"))
    return rows.select("doc_id", (F.col("before") + F.col("start")).alias("start"), held.alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(part) whose recipes do not give the manifest's root, rows, ids or place; empty if all hold."""
    now = _placed(_manifest(spark.read.parquet(f"{folder}/recipes")))
    listed = spark.read.parquet(f"{folder}/manifest")
    both = listed.select("part", F.struct("rows", "ids", "root", "before").alias("then")).join(
        now.select("part", F.struct("rows", "ids", "root", "before").alias("now")), "part", "full"
    )
    return both.where(~F.col("then").eqNullSafe(F.col("now"))).select("part")


def reconstruct(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents listed in ``wanted`` (doc_id)."""
    recipes = spark.read.parquet(f"{folder}/recipes").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.parquet(f"{folder}/chunks")
    found = _references(recipes).join(chunks, "chunk_id").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("chunks"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["payload"] for c in chunks), dtype="<u2").tolist() for chunks in batch.column("chunks").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return found.join(recipes.select("part", "row", "doc_id"), ["part", "row"]).mapInArrow(joined, "doc_id long, ids array<int>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
