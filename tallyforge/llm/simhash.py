"""SimHash near-duplicate documents by exact tiled comparison of fingerprints.

A fingerprint is made of the XXH64 hashes of a text's 4-word shingles. Fingerprints that
differ in at most RADIUS bits are linked; a document's class is its connected component.

How every link is found without comparing all pairs: equal fingerprints are one class
first. The 64 bits are cut into six blocks; two fingerprints within four bits agree on at
least two whole blocks, so both meet in one of the 15 groups keyed by a pair of blocks.
Inside a group, tiles of fingerprints are compared with numpy exclusive-or and bit counts, in
the order of their population counts: blocks whose counts differ by more than the radius are
skipped (bits that differ are at least that difference). A group larger than one tile is cut by
population count, each pair of tiles becomes a unit of work of its own, and pairs of tiles whose
counts differ by more than the radius are never formed.
A tile comparison reports a spanning forest of its links, never all pairs of a group.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a
text of under four words is one shingle; rows with a null id take part and link others, and
a class's id is the smallest non-null id (null if it has none); repeated rows share a class;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import saved, spread_join, table
from tallyforge.llm.components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in a tile at most, as aimed at; a comparison holds TILE x TILE words.
TILE = 2048


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text; bytes.lower and bytes.split touch ASCII only."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    first = np.concatenate(([0], ends[:-1] + 1))[: len(last)]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: str | None = None) -> DataFrame:
    """(id, fp) with the fingerprint as a signed bigint, and a carried column as ``place``."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(carried).alias("place")] if carried else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            columns = [batch.column("doc_id"), pa.array(found.view(np.int64)), *([batch.column("place")] if carried else [])]
            yield pa.record_batch(columns, names=["doc_id", "fp", *(["place"] if carried else [])])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *(f for f in ids.schema.fields if f.name == "place")])
    return ids.mapInArrow(run, schema)


def _masks() -> list[int]:
    """Signed masks of the pairs of blocks."""
    starts = np.concatenate(([0], np.cumsum(BLOCK_BITS)))
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(BLOCK_BITS, starts)]
    pairs = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in pairs]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes linked by i-j."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], least)
        np.minimum.at(low, low[j], least)
        low = low[low]
        open_ = low[i] != low[j]
        i, j = i[open_], j[open_]
    while (low != low[low]).any():
        low = low[low]
    return low


def _tile_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b within the radius, reduced to a spanning forest by blocks. Both
    are taken in the order of their population counts, and a block meets only the others whose
    counts are within the radius of its own."""
    none = np.empty(0, dtype=np.int64)
    n, out_i, out_j = len(a) + len(b), [none], [none]
    by_a, by_b = (np.argsort(np.bitwise_count(x), kind="stable") for x in (a, b))
    sorted_b = b[by_b]
    counts_a, counts_b = np.bitwise_count(a[by_a]).astype(np.int64), np.bitwise_count(sorted_b).astype(np.int64)
    for at in range(0, len(a), 256):
        block = by_a[at : at + 256]
        lo = np.searchsorted(counts_b, counts_a[at] - RADIUS, side="left")
        hi = np.searchsorted(counts_b, counts_a[at + len(block) - 1] + RADIUS, side="right")
        i, j = np.nonzero(np.bitwise_count(a[block][:, None] ^ sorted_b[None, lo:hi]) <= RADIUS)
        low = _forest(n, block[i], by_b[lo + j] + len(a))
        moved = np.flatnonzero(low != np.arange(n))
        out_i.append(moved)
        out_j.append(low[moved])
    return np.concatenate(out_i), np.concatenate(out_j)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted units of work (band, key, ta, tb), streamed over Arrow batches."""
    carried: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        unit = [rows.column(c).to_numpy() for c in ("band", "key", "ta", "tb")]
        fp, rep = rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
        n = len(fp)
        new = np.ones(n, dtype=bool)
        new[1:] = np.logical_or.reduce([u[1:] != u[:-1] for u in unit])
        starts = np.append(np.flatnonzero(new), n)
        sizes = np.diff(starts)
        group, left = np.cumsum(new) - 1, [np.empty(0, dtype=np.int64)]
        right = [left[0]]
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if n > d else left[0]
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
            left.append(i)
            right.append(i + d)
        for g in np.flatnonzero(sizes > 8):
            at, end = starts[g], starts[g + 1]
            if unit[2][at] == unit[3][at]:  # a tile with itself
                for lo in range(at, end, TILE):
                    for lo2 in range(lo, end, TILE):  # the other order says the same
                        a, b = np.arange(lo, min(lo + TILE, end)), np.arange(lo2, min(lo2 + TILE, end))
                        i, j = _tile_links(fp[a], fp[b])
                        both = np.concatenate((a, b))
                        left.append(both[i])
                        right.append(both[j])
            else:
                own = rows.column("tile").to_numpy()[at:end]
                a, b = at + np.flatnonzero(own == unit[2][at]), at + np.flatnonzero(own != unit[2][at])
                i, j = _tile_links(fp[a], fp[b])
                both = np.concatenate((a, b))
                left.append(both[i])
                right.append(both[j])
        low = _forest(n, np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero((low != np.arange(n)) & (rep != rep[low]))
        return pa.record_batch([pa.array(rep[moved]), pa.array(rep[low[moved]])], names=["a", "b"])

    def whole(rows: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(rows).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        same = all(
            carried and batch.column(c)[batch.num_rows - 1] == carried[0].column(c)[0] for c in ("band", "key", "ta", "tb")
        )
        carried.append(batch)
        if same:
            continue  # one unit so far, bounded by the tiles
        rows = whole(carried)
        last = [rows.column(c).to_numpy() for c in ("band", "key", "ta", "tb")]
        differs = np.logical_or.reduce([u != u[-1] for u in last])
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield links(rows.slice(0, cut).combine_chunks())
        carried = rows.slice(cut).combine_chunks().to_batches()
    if carried:
        yield links(whole(carried))


def _units(reps: DataFrame, tile: int) -> DataFrame:
    """Rows (band, key, ta, tb, tile, fp, rep): each fingerprint in each unit it belongs to."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])
    keyed = reps.select("fp", "rep", F.inline(bands))
    # Groups beyond a tile are few; their list is written first, so that its size is known
    # to the join below.
    large = saved(
        keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile), "simhash-large"
    )
    count = F.bit_count("fp")
    cut = keyed.join(large, ["band", "key"], "left").withColumn(
        "parts", F.when(F.col("n").isNull(), 0).otherwise(F.ceil(F.col("n") / (4 * tile))).cast("int")
    )
    # Near copies spread over several population counts, so four tiles' worth of rows make
    # about one tile each. A tile is a population count and a part by hash: tile = count * parts + part.
    own = cut.withColumn("tile", F.when(F.col("parts") == 0, 0).otherwise(count * F.col("parts") + F.pmod(F.xxhash64("fp"), "parts")).cast("int"))
    others = F.when(F.col("parts") == 0, F.array(F.lit(0))).otherwise(
        F.sequence(
            F.greatest(F.lit(0), count - RADIUS).cast("int") * F.col("parts"),
            (count + RADIUS).cast("int") * F.col("parts") + F.col("parts") - 1,
        )
    )
    return own.select("band", "key", "tile", "fp", "rep", F.explode(others).alias("_other")).select(
        "band", "key", F.least("tile", "_other").alias("ta"), F.greatest("tile", "_other").alias("tb"), "tile", "fp", "rep"
    )


def _named(prints: DataFrame, tile: int) -> DataFrame:
    """(fp, first, component) of each fingerprint of rows (fp, order): its first row by
    ``order``, and the smallest fingerprint that links lead to."""
    classes = saved(prints.groupBy("fp").agg(F.min("order").alias("first")), "simhash-classes")
    units = _units(classes.select("fp", F.col("fp").alias("rep")), tile)
    dealt = units.repartition("band", "key", "ta", "tb").sortWithinPartitions("band", "key", "ta", "tb")
    found = components(dealt.mapInArrow(_compare, "a long, b long"), "simhash-links")
    named = classes.join(found, classes.fp == found.node, "left")
    return saved(named.select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-named")


def cluster(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp). Saves ``prints`` once."""
    prints = saved(prints, "simhash-prints")
    named = _named(prints.select("fp", F.col("doc_id").alias("order")), tile)
    ids = saved(named.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-ids")
    of_class = spread_join(named.select("fp", "component"), ids, "component", "simhash-components").select("fp", "component_id")
    return spread_join(prints, of_class, "fp", "simhash-classes").select("doc_id", "fp", "component_id")


def _place(docs: DataFrame) -> Column:
    """The file, and the row in it, that each row of a table was read from."""
    at = docs.metadataColumn("_metadata")
    path = at["file_path"]
    return F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("check"), at["row_index"].alias("row")).alias("_place")


def _stored(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read from Parquet files, else a copy that is."""
    try:
        docs.select(_place(docs))
    except AnalysisException:
        return saved(docs, "simhash-docs")
    return docs


def keep_one(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """``docs`` (columns of ``documents``) with one row of each class: the one of the smallest
    id; of rows with that id, the smallest fingerprint's; of those, one row. Rows without an id
    come after all others, so a class of such rows keeps one.

    A row is known by its file and its number there, so different texts under one id are told
    apart. Texts are shuffled once, to meet the list of the rows that stay; a table that is not
    read from Parquet files is written first."""
    docs = _stored(docs)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"), F.col("place"))
    rows = docs.select("doc_id", "text", _place(docs))
    prints = saved(fingerprints(rows, carried="_place"), "simhash-prints")
    named = _named(prints.select("fp", order.alias("order")), tile)
    kept = saved(named.groupBy("component").agg(F.min("first").alias("first")).select("first.place.*"), "simhash-kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _place(docs)).select("_row", "_place.*")
    # By shuffle and sort, which spills, at every size: the list of rows that stay grows with the table.
    return whole.join(kept.hint("merge"), ["file", "check", "row"], "left_semi").select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = cluster(fingerprints(table(spark, sf_dir, "documents")))
    return clustered.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
