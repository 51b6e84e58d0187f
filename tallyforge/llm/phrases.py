"""Phrases of two and three words by SON partitioning, scored exactly.

The corpus is dealt to SHARDS shards by hash. Each shard is mined completely at the support
lowered to its share, SUPPORT / SHARDS: a phrase that has SUPPORT occurrences in all has that
many in some shard, whatever the shards' true sizes. The union of the locally frequent phrases
then is counted exactly over all texts. Phrases whose local counts show that they cannot reach
SUPPORT (a shard where a phrase is not frequent adds less than the local support) leave the union
before that.

Words and pairs are mined in one pass over the texts, triples in a second one, from pairs of the
union alone; a third pass counts. Each cuts texts with numpy where they lie and combines counts in
a task before they are shuffled. Mining shuffles 64-bit hashes of phrases; they serve only to rule
phrases out, and a phrase that shares its hash with another can only be counted for nothing. Tasks
know the union as a bitmap of 2^FILTER_BITS bits, a size that does not depend on the corpus; what
passes is grouped and counted by the words themselves (within a slice of one
MB equal 64-bit hashes stand for equal phrases). A shard is no task: its phrases are dealt
over the cluster by hash.

Scores are exact in decimals of 38 digits: counts stay below 10^14.

Defined cases: a null text is empty; a null language is ``und``, and so joins rows of that name;
rows without an id, repeated rows and ids all count; a text without words adds nothing; phrases do
not cross pieces or texts; equal scores go by count, then by the phrase's bytes; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, spread_join, table

#: Least occurrences of a phrase, its most words, and phrases reported of a language.
SUPPORT, LONGEST, FIRST = 10, 3, 2_000
#: Shards of the corpus: fewer than SUPPORT, so that the local support is above one.
SHARDS = 5
#: Bits of the second pass's filter: 16 MB.
FILTER_BITS = 27
#: Bytes of text cut together, and counts that a task holds before it passes them on.
TOGETHER, HELD = 1 << 20, 1 << 19
#: Rows that a task hands on at once.
ROWS = 1 << 15
UNKNOWN = "und"

_U = np.uint64
_BYTE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_SPACE, _PIECE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09]] = True
_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(size, _STEP, dtype=np.uint64))
                self.down = np.cumprod(np.full(size, pow(_STEP, -1, 1 << 64), dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """The words of some texts: limits in ``data``, hash, piece and text of each."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    doc: np.ndarray

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """The phrases of n words that start at some words, joined by single spaces."""
        data = self.data
        parts = [[data[a:b] for a, b in zip(self.start[at + j].tolist(), self.end[at + j].tolist())] for j in range(n)]
        return parts[0] if n == 1 else list(map(b" ".join, zip(*parts)))


def cut(texts: list[bytes | None]) -> Words:
    """Texts as UTF-8 bytes, A to Z lower-cased, cut into pieces and words."""
    texts = [t or b"" for t in texts]
    data = b"\n" + b"\n".join(texts).lower() + b"\n"
    codes = np.frombuffer(data, dtype=np.uint8)
    piece = _PIECE[codes]
    apart = piece | _SPACE[codes]
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    up, down = _powers.of(len(codes))
    sums = np.cumsum(_BYTE[codes] * up)
    hashed = _mixed((sums[end - 1] - sums[start - 1]) * down[start])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return Words(data, start, end, hashed, np.cumsum(piece)[start], np.searchsorted(limits, start - 1, side="right"))


def keys(words: Words, langs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the phrases of 1 to LONGEST words; a phrase of each language of its
    own. ``langs`` has a hash for each text."""
    own = _mixed(words.hash + langs[words.doc])
    at, key = np.arange(len(own)), own
    found = [(at, key)]
    for n in range(2, LONGEST + 1):
        last = at + (n - 1)
        whole = np.flatnonzero(last < len(own))
        whole = whole[words.piece[at[whole]] == words.piece[last[whole]]]
        at, key = at[whole], _mixed(key[whole] * _U(0x9FB21C651E98DF25) + own[last[whole]] + _U(n))
        found.append((at, key))
    return found


class _Counts:
    """Counts of hashes that a task holds: combined when many, passed on when too many."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append(np.unique(key, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self._combine()
            if self.size > self.most // 2:
                yield from self.rest()

    def _combine(self) -> None:
        key, count = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(key)
        key, count = key[order], count[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.parts, self.size = [(key[new], np.add.reduceat(count, new))], len(new)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            self._combine()
            yield self.parts[0]
        self.parts, self.size = [], 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], np.ndarray]]:
    """Rows of batches in slices of bounded text: the rows, their texts, their languages' hashes."""
    for batch in batches:
        column = batch.column("text")
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        langs = batch.column("lang_hash").to_numpy(zero_copy_only=False).astype(np.uint64)
        first, before = 0, 0
        while first < batch.num_rows:
            # As many rows as fit, and at least one.
            last = max(first + 1, int(np.searchsorted(sizes, before + TOGETHER, side="right")))
            yield batch.slice(first, last - first), column.slice(first, last - first).cast(pa.binary()).to_pylist(), langs[first:last]
            first, before = last, int(sizes[last - 1])


def texts_of(docs: DataFrame) -> DataFrame:
    """(lang, lang_hash, shard, text) of documents (lang, text)."""
    named = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    # Copies of one text may all lie in one shard; its local support holds all the same.
    return named.select("lang", F.xxhash64("lang").alias("lang_hash"), F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SHARDS)).cast("int").alias("shard"), "text")


def _passed(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each hash."""
    place = key >> _U(64 - FILTER_BITS)
    return (held[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 > 0


def _low(shards: int) -> int:
    """The last bits of a hash, which a shard's number takes."""
    return (1 << max(1, (shards - 1).bit_length())) - 1


def _mined(texts: DataFrame, lengths: tuple[int, ...], known: bytes | None, support: int, shards: int) -> DataFrame:
    """(key): hashes of the phrases of some lengths that are frequent in some shard and may reach
    the support. With ``known``, the bitmap of the phrases of one word fewer, only those whose two
    such parts it has: the others are frequent in no shard."""
    local, low = -(-support // shards), _low(shards)
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(HELD)
        held = None if sent.value is None else np.frombuffer(sent.value, dtype=np.uint8)

        def rows(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for key, count in found:
                for i in range(0, len(key), ROWS):
                    yield pa.record_batch([pa.array(key[i : i + ROWS].view(np.int64)), pa.array(count[i : i + ROWS].astype(np.int64))], names=["key", "count"])

        for part, own, langs in _slices(batches):
            shard = part.column("shard").to_numpy().astype(np.uint64)
            words = cut(own)
            levels = keys(words, langs)
            for n in lengths:
                at, key = levels[n - 1]
                if held is not None:
                    place, shorter = levels[n - 2]
                    frequent = np.zeros(len(words.hash) + 1, dtype=bool)
                    frequent[place] = _passed(held, shorter & ~_U(low))
                    whole = np.flatnonzero(frequent[at] & frequent[at + 1])
                    at, key = at[whole], key[whole]
                # The shard takes the hash's last bits, so that a row is two numbers.
                yield from rows(counts.add((key & ~_U(low)) | shard[words.doc[at]]))
        yield from rows(counts.rest())

    mined = texts.mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).where(F.col("count") >= local)
    union = mined.groupBy(F.col("key").bitwiseAND(F.lit(~low)).alias("key")).agg(F.sum("count").alias("count"), F.count("*").alias("shards"))
    return union.where(F.col("count") + (shards - F.col("shards")) * (local - 1) >= support).select("key")


def locally_frequent(texts: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[bytes, list[DataFrame]]:
    """The union of the shards' frequent phrases: as a bitmap, and as tables (key). Words and pairs
    are mined together, longer phrases level by level."""
    found = [saved(_mined(texts, (1, 2), None, support, shards), "phrase-union")]
    held = _bitmap(found[0])
    for n in range(3, LONGEST + 1):
        found.append(saved(_mined(texts, (n,), held, support, shards), "phrase-union"))
        held = (np.frombuffer(held, dtype=np.uint8) | np.frombuffer(_bitmap(found[-1]), dtype=np.uint8)).tobytes()
    return held, found


def _bitmap(union: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of 2^bits bits: bit h is set if a hash of the union starts with h."""
    word = 20  # bits of a place within a block: 128 KB
    places = union.select(F.shiftrightunsigned("key", 64 - bits).alias("at")).distinct()

    def block(part: pa.Table) -> pa.Table:
        row = np.zeros(1 << word, dtype=bool)
        at = part.column("at").to_numpy()
        row[at & ((1 << word) - 1)] = True
        return pa.table({"block": [int(at[0]) >> word], "bits": [np.packbits(row, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    blocks = places.withColumn("block", F.shiftright("at", word)).groupBy("block").applyInArrow(block, "block long, bits binary")
    for r in blocks.collect():
        out[r.block << (word - 3) : (r.block + 1) << (word - 3)] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.tobytes()


def counted(texts: DataFrame, union: bytes, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """(lang, words, phrase, f): exact counts of the phrases of 1 to LONGEST words, by hash in the
    union, that have the support; and of all words of a language, with 0 words and no phrase."""
    sent = texts.sparkSession.sparkContext.broadcast(union)
    low = _low(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, dtype=np.uint8)

        def rows(lang: pa.Array, n: int, made: list[bytes | None], count: np.ndarray) -> pa.RecordBatch:
            columns = [lang, pa.array(np.full(len(made), n, dtype=np.int32)), pa.array(made, pa.binary()).cast(pa.string()), pa.array(count.astype(np.int64))]
            return pa.record_batch(columns, names=["lang", "words", "phrase", "f"])

        for part, own, langs in _slices(batches):
            words, lang = cut(own), part.column("lang")
            yield rows(lang, 0, [None] * len(own), np.bincount(words.doc, minlength=len(own)))
            for n, (at, key) in enumerate(keys(words, langs), 1):
                passed = np.flatnonzero(_passed(held, key & ~_U(low)))
                _, first, count = np.unique(key[passed], return_index=True, return_counts=True)
                first = at[passed[first]]
                for i in range(0, len(first), ROWS):
                    some = first[i : i + ROWS]
                    yield rows(lang.take(pa.array(words.doc[some])), n, words.phrases(some, n), count[i : i + ROWS])

    found = texts.mapInArrow(run, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= support) | (F.col("words") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every candidate at its lowest-scoring cut, without
    those that a longer candidate holds in half of their occurrences or more.

    ``counts`` has every part of a candidate, since a part is as frequent as the whole."""
    space = "split(phrase, ' ')"
    candidates = counts.where("words > 1").withColumn("w", F.expr(space))
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select(
        "lang", "phrase", "words", "a", "k",
        F.explode(F.array(
            F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
            F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("part")),
        )).alias("s"),
    ).select("lang", "phrase", "words", "a", "k", "s.*")
    at = F.concat_ws("\n", "lang", "part")  # no word holds a line break
    sides = saved(sides.withColumn("_key", at), "phrase-parts")
    parts = counts.where(F.col("words").between(1, LONGEST - 1)).select(F.concat_ws("\n", "lang", "phrase").alias("_key"), "f")
    met = saved(spread_join(sides, parts, "_key", "phrase-parts", "inner"), "phrase-met")
    both = met.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    exact = F.expr("CAST(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0))) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    lowest = both.withColumn("score", exact).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    best = lowest.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")
    # Any part of one word fewer lies at an end; shorter parts are parts of those, and not candidates here.
    inside = met.where("words > 2 AND 100 * a >= 50 * f AND instr(part, ' ') > 0").select("lang", F.col("part").alias("phrase")).distinct()
    return best.join(inside, ["lang", "phrase"], "left_anti")


def phrases(docs: DataFrame, support: int = SUPPORT, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of (lang, text)."""
    texts = texts_of(docs)
    union, _ = locally_frequent(texts, support)
    counts = saved(counted(texts, union, support), "phrase-counts")
    best = scored(counts)
    by = (F.desc("score"), F.desc("a"), "phrase")
    # The first of each sixteenth of a language, then of all these: Spark drops what is past the
    # limit in every task before a shuffle, and no task gets more than 16 x ``first`` rows at last.
    parts = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    parts = parts.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).where(F.col("_n") <= first)
    top = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= first)
    named = top.join(counts.where("words = 0").select("lang", F.col("f").alias("n")), "lang")
    return named.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\\x20\\x09]+') if x <> ''] AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
  FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
s AS (SELECT lang, k, phrase, a, j, array_to_string(x[1:j], ' ') AS p1, array_to_string(x[j + 1:k], ' ') AS p2 FROM c, (VALUES (1), (2)) v(j) WHERE j < k),
e AS (SELECT s.*, f1.f AS l, f2.f AS r, CAST(1000000::HUGEINT * a * a // (f1.f::HUGEINT * f2.f) AS BIGINT) AS score
  FROM s JOIN f f1 ON f1.lang = s.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = s.lang AND f2.phrase = p2),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM e),
d AS (SELECT lang, p1 AS phrase FROM e WHERE k = 3 AND j = 2 AND 100 * a >= 50 * l UNION SELECT lang, p2 FROM e WHERE k = 3 AND j = 1 AND 100 * a >= 50 * r),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
  WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase))
SELECT q.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000"""
