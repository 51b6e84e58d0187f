"""Periodic runs of words: stretches that repeat with a period, and texts with the repeats cut.

Runs come from an enhanced suffix array of each text's words (Stoye and Gusfield's test, on
LCP intervals instead of tree nodes). An LCP interval of depth d holds the suffixes that share
their first d words. Two of its suffixes d places apart, in different children, start a square
of period d that no further word extends: a branching tandem repeat. For every suffix of all
children but the largest the inverse suffix array tells whether its place plus or minus d lies
in the interval too, so a text of n words needs n log n tests at most. Each square is rotated
left as far as its words repeat; squares that cover one stretch are merged under the smallest
period. Every run ends in one such square, so no run is missed.

All steps are numpy over many texts at once: ranks by prefix doubling (kept for each doubling),
LCP values and rotations by descending through these ranks, interval limits by descending
through minima of 2^k neighbours. Rows are judged where they lie: nothing is shuffled. A task
holds about TOGETHER words at a time, or one longer text, at some 400 bytes a word.

Defined cases: a null, empty or blank text has no words and no runs; repeated rows and ids get
equal answers, one row each; a null id is an id like others; runs that cover one stretch are one
run, with the smallest period; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Words of texts that are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 16
#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of some keys; equal keys have equal ranks."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate(([0], sorted_keys[1:] != sorted_keys[:-1])))
    return out


class SuffixArray:
    """Suffix array of several texts at once: suffixes stand by text, then by their words.

    ``levels[k]`` ranks places by the 2^k words from there on; equal ranks mean equal words."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, end: np.ndarray):
        """``ids``: word numbers, ``doc``: the text of each word (rising), ``end``: its text's end."""
        n = len(ids)
        self.n, self.end = n, end
        rank = _dense(doc * (int(ids.max(initial=0)) + 1) + ids)
        self.levels, width = [rank], 1
        while True:
            # Ranks are places in the order of suffixes from here on: a group of equals keeps
            # the place of its first, so only groups of several are sorted again.
            size = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero(size[rank] > 1)
            if not len(open_):
                break
            first = np.concatenate(([0], np.cumsum(size)))[rank[open_]]
            ahead = open_ + width
            inside = ahead < end[open_]
            next_rank = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
            order = np.lexsort((next_rank, first))
            f, r = first[order], next_rank[order]
            new_group = np.concatenate(([True], f[1:] != f[:-1]))
            new = new_group | np.concatenate(([True], r[1:] != r[:-1]))
            at = np.arange(len(order))
            in_group = at - np.maximum.accumulate(np.where(new_group, at, 0))
            place = f + in_group - (at - np.maximum.accumulate(np.where(new, at, 0)))
            # ``rank`` counts distinct values; in order of places, distinct values rise with it.
            places = np.concatenate(([0], np.cumsum(size)))[rank]
            places[open_[order]] = place
            rank = _dense(places) if len(open_) > n // 8 else _renumbered(places, n)
            self.levels.append(rank)
            width *= 2
        self.place = rank  # the inverse suffix array: all ranks differ
        self.suffix = np.empty(n, dtype=np.int64)
        self.suffix[rank] = np.arange(n)
        self.lcp = self._lcp()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b share (a and b differ)."""
        shared = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a[live] + shared[live], b[live] + shared[live]
            fits = (x < self.n) & (y < self.n)
            same = np.zeros(len(live), dtype=bool)
            same[fits] = self.levels[k][x[fits]] == self.levels[k][y[fits]]
            shared[live[same]] += 1 << k
        return shared

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a and before b that are equal, counted backwards."""
        shared = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - shared - (1 << k), b - shared - (1 << k)
            fits = (x >= 0) & (y >= 0)
            same = np.zeros(len(a), dtype=bool)
            same[fits] = self.levels[k][x[fits]] == self.levels[k][y[fits]]
            shared[same] += 1 << k
        return shared

    def _lcp(self) -> np.ndarray:
        """Shared words of each suffix with the one before it in order."""
        lcp = np.zeros(self.n, dtype=np.int64)
        first = self.levels[0][self.suffix]
        alike = np.flatnonzero(first[1:] == first[:-1]) + 1
        lcp[alike] = self.common(self.suffix[alike - 1], self.suffix[alike])
        return lcp


def _renumbered(places: np.ndarray, n: int) -> np.ndarray:
    """Distinct ranks of places below n, without sorting."""
    seen = np.zeros(n, dtype=bool)
    seen[places] = True
    return (np.cumsum(seen) - 1)[places]


def _limits(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For LCP values at some indexes: the last index before with a smaller value, the next
    index with a smaller one, and the next with a smaller or equal one."""
    value, n = lcp[at], len(lcp)
    # Values are 0 between groups of one first word, so no limit is further than the longest group.
    zero = np.flatnonzero(lcp == 0)
    longest = int(np.diff(np.concatenate((zero, [n]))).max(initial=1))
    minima = [lcp]
    while 1 << len(minima) <= longest:
        last, step = minima[-1], 1 << (len(minima) - 1)
        wider = np.zeros(n, dtype=np.int64)
        wider[: n - step] = np.minimum(last[: n - step], last[step:])
        minima.append(wider)
    before, after, child = at.copy(), at + 1, at + 1
    for k in range(len(minima) - 1, -1, -1):
        step, low = 1 << k, minima[k]
        x = before - step
        before = np.where((x >= 0) & (low[np.maximum(x, 0)] >= value), x, before)
        ok = after + step <= n
        after = np.where(ok & (low[np.minimum(after, n - 1)] >= value), after + step, after)
        ok = child + step <= n
        child = np.where(ok & (low[np.minimum(child, n - 1)] > value), child + step, child)
    return before - 1, after, child


def branching(sa: SuffixArray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats."""
    lcp, none = sa.lcp, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(lcp)
    if not len(at):
        return none, none
    depth = lcp[at]
    left, right, child = _limits(lcp, at)
    # Children of an interval: one right of each of its inner indexes, and the first one.
    of = left * (int(depth.max()) + 1) + depth
    order = np.lexsort((at, of))
    at, depth, left, right, child, of = (x[order] for x in (at, depth, left, right, child, of))
    head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    number = np.cumsum(np.concatenate(([0], of[1:] != of[:-1])))
    begins = np.concatenate((at, left[head]))
    ends = np.concatenate((child, at[head]))
    owner = np.concatenate((number, np.arange(len(head))))
    size = ends - begins
    order = np.lexsort((begins, -size, owner))
    largest = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
    small = np.ones(len(size), dtype=bool)
    small[largest] = False
    begins, size, owner = begins[small], size[small], owner[small]
    total = int(size.sum())
    step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    suffix = sa.suffix[np.repeat(begins, size) + step]
    owner = np.repeat(owner, size)
    d, low, high = depth[head][owner], left[head][owner], right[head][owner]
    found = []
    for other, first in ((suffix + d, suffix), (suffix - d, suffix - d)):
        inside = np.flatnonzero((other >= 0) & (other < sa.n))
        place = sa.place[other[inside]]
        inside = inside[(place >= low[inside]) & (place < high[inside])]
        found.append((first[inside], d[inside]))
    start, period = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    # In different children: the two suffixes share d words and no more.
    x, y = start + period, start + 2 * period
    goes_on = y < sa.end[start]
    parts = ~goes_on | (ids[np.minimum(x, sa.n - 1)] != ids[np.minimum(y, sa.n - 1)])
    return start[parts], period[parts]


def runs_of(texts: list[list[str]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of some texts' words, by text, start, period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = list(chain.from_iterable(texts))
    known = {word: number for number, word in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
    none = np.zeros(0, dtype=np.int64)
    if not len(ids):
        return none, none, none, none
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    sa = SuffixArray(ids, doc, (begin + sizes)[doc])
    start, period = branching(sa, ids)
    end = start + 2 * period
    start = start - sa.back(start, start + period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(start) else np.zeros(0, dtype=bool)
    length = end - start
    kept = new & (length >= np.maximum(least_words, least_periods * period))
    start, length, period = start[kept], length[kept], period[kept]
    of = doc[start]
    order = np.lexsort((period, start, of))
    return of[order], (start - begin[of])[order], length[order], period[order]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """Words of runs of rows of a bounded number of words, with the first row's number."""
    held: list[list[str]] = []
    first = count = 0
    for n, text in enumerate(column):
        words = words_of(text.as_py() or "")
        if held and count + len(words) > TOGETHER:
            yield first, held
            held, first, count = [], n, 0
        held.append(words)
        count += len(words)
    if held:
        yield first, held


def find(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``runs``: start, length and period, in words, of every run of a row's text,
    by start and period. A column of ``docs`` of that name is left out."""
    names = [c for c in docs.columns if c != "runs"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = rows.withColumn("runs", F.lit(None).cast(RUNS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for first, held in _groups(batch.column(names.index(text))):
                of, *values = runs_of(held, least_words, least_periods)
                cut = np.searchsorted(of, np.arange(len(held) + 1))
                made = pa.StructArray.from_arrays([pa.array(v) for v in values], ["start", "length", "period"])
                found = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), made).cast(kind)
                yield pa.record_batch([*batch.slice(first, len(held)).columns, found], names=[*names, "runs"])

    return rows.mapInArrow(run, schema)


def kept_words(words: list[str], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[str]:
    """The words without those that a run repeats: what follows its first period."""
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [w for w, n in zip(words, np.cumsum(edge).tolist()) if not n]


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every run cut to its first period: the kept words joined by spaces. Texts
    without a run stay as they are, white space included."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in _groups(batch.column(at)):
                own = batch.slice(first, len(held))
                texts = own.column(at).to_pylist()
                of, *values = runs_of(held)
                cut = np.searchsorted(of, np.arange(len(held) + 1))
                for n in np.flatnonzero(np.diff(cut)).tolist():
                    texts[n] = " ".join(kept_words(held[n], *[v[cut[n] : cut[n + 1]] for v in values]))
                columns = list(own.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with the repeats that the query's contract plants in one id of ten: a pure
    rewriting of the input, before runs are sought."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(docs: DataFrame, rewrite: Callable[[int | None, list[str]], list[str]] = planted) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of
    every row of (doc_id, text), its words rewritten first."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, held in _groups(batch.column(1)):
                own = doc_ids[first : first + len(held)]
                held = [rewrite(d, words) for d, words in zip(own, held)]
                of, start, length, period = runs_of(held)
                cut = np.searchsorted(of, np.arange(len(held) + 1)).tolist()
                out = []
                for n, (doc_id, words) in enumerate(zip(own, held)):
                    s, z, p = (v[cut[n] : cut[n + 1]] for v in (start, length, period))
                    best = (None,) * 4
                    if len(s):
                        k = int(np.lexsort((p, s, -z))[0])
                        best = (int(s[k]), int(z[k]), int(p[k]), int(1000 * z[k] // p[k]))
                    listed = "".join(f"{x},{y},{q}\n" for x, y, q in zip(s.tolist(), z.tolist(), p.tolist()))
                    kept = " ".join(kept_words(words, s, z, p))
                    out.append((doc_id, len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
