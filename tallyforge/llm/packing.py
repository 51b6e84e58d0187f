"""Packing token sequences by minimum bin slack.

Each document's ids, with an end id, are cut into full windows and one remaining piece.
Full windows are sequences of their own. Remaining pieces fill windows by minimum bin
slack: the longest piece left opens a window, a subset-sum dynamic program over a bitset
of reachable totals (one bit per length up to the window) picks the multiset of other
lengths that comes closest to the capacity, and backtracking gives its counts. A pattern
is repeated as long as its lengths last, so a program runs once per pattern.

Where no multiset comes within ``GRAIN`` ids of the capacity - many pieces of one length,
say - a further piece is cut at a multiple of GRAIN to fill the gap; its checksum follows
from the checksums kept at those places, so ids are never moved.

Pieces are dealt to buckets of about ``BUCKET`` rows by a number given at their making;
a bucket is packed in one task in bounded memory and leaves at most one window part
empty, about 0.02 % of the ids. Nothing depends on other buckets.

Defined cases: a null or empty text is its end id alone; repeated ids and repeated rows
are packed once for each row; null ids are carried; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, table
from tallyforge.llm.tokens import BYTE_BPE, encoder, tokenizer_path

WINDOW = 1024
END_ID = 0
#: Places where a remaining piece may be cut, in ids from its start.
GRAIN = 16
BUCKET = 8192

PIECES = "bucket_key long, row_id long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, marks binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows and remaining pieces, with checksums; ``marks`` are the checksums of a
    remaining piece's first GRAIN, 2 GRAIN, ... ids as little-endian unsigned integers."""
    path = path or tokenizer_path(BYTE_BPE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made = encoder(path, False).encode, TaskContext.get().partitionId() << 40, 0
        row_id = task - 1
        for batch in batches:
            rows: list[tuple] = []
            docs = batch.column(0).to_pylist()
            for first, ids, ends in encode(batch.column(1), END_ID):
                raw, begin = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, end in zip(docs[first:], ends.tolist()):
                    n, row_id = end - begin, row_id + 1
                    for start in range(0, n, WINDOW):
                        piece, marks = raw[4 * (begin + start) : 4 * min(begin + start + WINDOW, end)], b""
                        crc = so_far = 0
                        if n - start < WINDOW:
                            at = []
                            for stop in range(4 * GRAIN, len(piece), 4 * GRAIN):
                                crc, so_far = zlib.crc32(piece[so_far:stop], crc), stop
                                at.append(crc)
                            marks = array("I", at).tobytes()
                        rows.append((task + made, row_id, doc, n, start, len(piece) // 4, zlib.crc32(piece[so_far:], crc), marks))
                        made += 1
                    begin = end
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose total is the largest up to
    ``capacity``: a bitset holds the reachable totals, each length is added in powers of
    two of its count, and the program stops once the capacity itself is reached."""
    whole, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, unit = min(counts[length], capacity // length), 1
        while left:
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & whole
            left, unit = left - take, unit * 2
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    total, chosen = (reach & whole).bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # the total can't be reached without this step
            chosen[length] += take
            total -= length * take
    return dict(chosen)


@lru_cache(maxsize=4096)
def _shift_table(n_bytes: int) -> tuple[int, ...]:
    """Images of the 32 bits of a checksum under n_bytes further zero bytes."""
    # zlib.crc32(b, c) folds c in linearly: c's image is crc(zeros, c) ^ crc(zeros, 0).
    zeros = bytes(n_bytes)
    none = zlib.crc32(zeros, 0)
    return tuple(zlib.crc32(zeros, 1 << b) ^ none for b in range(32))


def shifted(crc: int, n_bytes: int) -> int:
    """What ``crc`` of a prefix contributes to the checksum of the prefix and n_bytes more."""
    out, images = 0, _shift_table(n_bytes)
    while crc:
        low = crc & -crc
        out ^= images[low.bit_length() - 1]
        crc ^= low
    return out


def pack(lengths: list[int], cut_ok: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, from, to) for pieces of the given lengths, under WINDOW.

    A cut piece's later part goes back among the pieces, by its new length."""
    stacks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, n in enumerate(lengths):
        stacks[n].append((i, 0, n))
    counts = {n: len(s) for n, s in stacks.items()}
    windows = []

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return stacks[length].pop()

    while counts:
        first = max(counts)
        counts[first] -= 1
        fill = best_fill({n: c for n, c in counts.items() if c}, WINDOW - first)
        counts[first] += 1
        fill[first] = fill.get(first, 0) + 1
        gap = WINDOW - sum(n * k for n, k in fill.items())
        for _ in range(min(counts[n] // k for n, k in fill.items())):
            window = [take(n) for n, k in fill.items() for _ in range(k)]
            windows.append(window)
            if cut_ok and gap >= GRAIN and counts:
                i, a, b = take(max(counts))  # longer than the gap, else it would have been in the fill
                middle = a + gap // GRAIN * GRAIN
                if middle >= b:
                    stacks[b - a].append((i, a, b))
                    counts[b - a] = counts.get(b - a, 0) + 1
                    continue
                window.append((i, a, middle))
                stacks[b - middle].append((i, middle, b))
                counts[b - middle] = counts.get(b - middle, 0) + 1
                break  # the counts changed: a new program
    return windows


def _pack_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    bucket, out = key[0].as_py() << 32, []
    rows = rows.sort_by("bucket_key")
    names = ("row_id", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "marks")
    row, doc, tokens, start, length, crc, marks = (rows.column(c).to_pylist() for c in names)
    full = [i for i, n in enumerate(length) if n == WINDOW]
    rest = [i for i, n in enumerate(length) if n < WINDOW]
    windows = [[(i, 0, WINDOW)] for i in full]
    windows += [[(rest[i], a, b) for i, a, b in w] for w in pack([length[i] for i in rest])]

    def upto(i: int, at: int) -> int:
        if at == length[i]:
            return crc[i]
        return int(np.frombuffer(marks[i], dtype="<u4")[at // GRAIN - 1])

    for w, window in enumerate(windows):
        offset = 0
        for i, a, b in window:
            own = upto(i, b) if a == 0 else upto(i, b) ^ shifted(upto(i, a), 4 * (b - a))
            out.append((doc[i], start[i] + a, b - a, own, tokens[i], bucket + w, offset, row[i]))
            offset += b - a
    columns = list(zip(*out))
    fields = [f.split()[0] for f in PACKED.split(", ")]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=fields)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: its place in its document and in its sequence; ``row_id`` tells rows of
    one id, such as copies, apart."""
    cut = saved(pieces(docs, path), "packing-pieces")
    buckets = max(1, -(-cut.count() // BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("bucket_key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_pack_bucket, PACKED)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
