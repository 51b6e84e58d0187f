"""Toxicity by a convolutional text classifier, trained in numpy.

Words have hashed embeddings: the sum of the vectors of a word and of its beginnings of 3 to 6
letters, so that inflected and unseen forms share what their beginnings show. Filters of 1, 2 and
3 words run over the whole text; each is pooled by its TOP largest values (one hit and several
tell different stories), and a linear layer over these gives a logit. Vectors start as the log
ratio of the documents that hold them (toxic to others) beside noise; Adam trains everything.

Thresholds are calibrated by language: each language that the learned rows name gets the
threshold with the best F1 on rows that a net did not see (FOLDS nets, each blind to a part),
pulled to the threshold of all rows as far as its toxic rows are few (below PULL of them: that
threshold itself). A score is logistic in the
distance from the threshold of the text's language and 0.7 on it. Which language a text has is
told from its words alone (naive Bayes over the same hashed words), at scoring as at calibration;
the column ``lang`` names the classes of the learned rows and is never an input of a score.

Everything is learned from all labelled rows that are not held out, where they lie. They are
written once as hashed words, dealt by hash to shards of some SHARD rows. Documents that hold a
vector and words of a language are counted by grouping. In each of EPOCHS rounds every shard trains
the nets from the same start; nets are then averaged, each vector over the shards that hold it, in
the measure of their words that do. Logits of rows that a net did not see are counted by
language, class and value (to 1 / GRID), and thresholds are those of the counts. What reaches the
driver are counts and sums of parameters, whatever the number of rows. ``fit`` with ``per_class`` is
for trials: it learns from a bounded sample, in one process.

Defined cases: a null text counts as empty, and an empty text gets the score of no words at all;
rows are judged one by one, so repeated rows get equal scores; a null id is not held out and not
learned from; an id with several labels counts once, as toxic if one of them says so; a null label
is none; an id of several texts gives several rows to learn from; without labels of both classes
every score is 0; texts of no learned language get the threshold of all rows; further columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from copy import deepcopy
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import least_hashed, likely_least, saved, spread_join, table

#: Hashed vectors and their size; vectors of a word: its own, then its beginnings.
BUCKETS, DIM = 1 << 15, 12
BEGINNINGS = (3, 4, 5, 6)
PARTS = 1 + len(BEGINNINGS)
#: Filters of each width, and the largest values that each keeps of a text.
WIDTHS = {1: 16, 2: 8, 3: 8}
FILTERS = sum(WIDTHS.values())
TOP = 3
#: Of each filter: its width, how many have that width, and its column in the projection.
WIDTH, COUNT, COLUMN = (np.array(c) for c in zip(*[(w, n, sum(v * m for v, m in WIDTHS.items() if v < w) + k) for w, n in WIDTHS.items() for k in range(n)]))
#: Words of a trial's sample, at most.
MOST_WORDS = 1_500_000
#: Labelled rows of a shard on average; rows and words that are trained on together, at most; tasks
#: of a round, at most.
SHARD, SHARD_ROWS, SHARD_WORDS, MOST_TASKS = 1_536, 4_096, 1_500_000, 1_024
#: Bits of the hashes of labelled ids.
FILTER_BITS = 25
#: Numbers of a sum of parameters in one row; steps of a logit of 1, and the largest logit, in counts.
BLOCK, GRID, LARGEST = 1 << 13, 1 << 10, 64
#: Documents that have a vector, at least, for it to count.
LEAST_DOCS = 4
FOLDS, EPOCHS, BATCH = 2, 5, 32
#: The score on a language's threshold; toxic rows that a language needs for a threshold of its
#: own, and by which it then outweighs the threshold of all.
AT_THRESHOLD, PULL = 0.7, 10
#: Share of 3 whose ids are held out of learning, by crc32.
HELD_OUT = 1
#: Words scored together, and words that a worker remembers.
TOGETHER, CACHE = 1 << 16, 400_000
#: ASCII words below so many letters are hashed together.
SHORT = 15

_WORD = re.compile(r"[^\W_]+")
#: The characters of Latin-1, with a blank for those that stand in no word.
_LATIN = bytes(c if _WORD.fullmatch(chr(c)) else 32 for c in range(256))


def buckets_of(words: Sequence[str]) -> np.ndarray:
    """(words, PARTS): places of the words' vectors, by XXH32; place 0 is empty."""
    import xxhash

    digest, found = xxhash.xxh32_intdigest, np.zeros((len(words), PARTS), dtype=np.int64)
    short = np.fromiter((len(w) < SHORT and w.isascii() for w in words), dtype=bool, count=len(words))
    if short.any():
        found[short] = _short_hashes([w for w in words if len(w) < SHORT and w.isascii()])
    for n in np.flatnonzero(~short).tolist():
        w = words[n]
        own = [digest("=" + w), *(digest("^" + w[:k]) for k in BEGINNINGS if k <= len(w))]
        found[n, : len(own)] = own
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.where(sizes[:, None] >= np.array([0, *BEGINNINGS]), found % (BUCKETS - 1) + 1, 0)


def _short_hashes(words: list[str]) -> np.ndarray:
    """XXH32 of "=" and each word and of "^" and its beginnings, for ASCII words below SHORT letters:
    the steps of that hash for at most 15 bytes, for all words together. What is too short for a
    beginning gets any number."""
    data = np.array(words, dtype=f"S{SHORT - 1}").view(np.uint8).reshape(len(words), SHORT - 1)
    sizes, sign = np.fromiter(map(len, words), dtype=np.uint32, count=len(words)), np.zeros((len(words), 1), dtype=np.uint8)
    whole = np.concatenate([sign + ord("="), data], axis=1)
    begun = np.concatenate([sign + ord("^"), data[:, : max(BEGINNINGS)]], axis=1)
    return np.stack([_xxh32(whole, sizes + np.uint32(1)), *(_xxh32(begun[:, : k + 1], np.full(len(words), k + 1, dtype=np.uint32)) for k in BEGINNINGS)], axis=1)


def _xxh32(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH32 (seed 0) of the first ``sizes`` bytes of each row, at most 15."""
    one, two, three, four, five = (np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    turn = lambda h, n: (h << np.uint32(n)) | (h >> np.uint32(32 - n))
    h, width = sizes + five, data.shape[1]
    for at in range(0, width - 3, 4):
        word = np.ascontiguousarray(data[:, at : at + 4]).view("<u4")[:, 0]
        h = np.where(sizes >= at + 4, turn(h + word * three, 17) * four, h)
    for at in range(width):
        tail = (at < sizes) & (at >= sizes & np.uint32(0xFFFFFFFC))
        if tail.any():
            h = np.where(tail, turn(h + data[:, at].astype(np.uint32) * five, 11) * one, h)
    h = (h ^ (h >> np.uint32(15))) * two
    h = (h ^ (h >> np.uint32(13))) * three
    return h ^ (h >> np.uint32(16))


def buckets(word: str) -> list[int]:
    """Places of one word's vectors."""
    return buckets_of([word])[0].tolist()


def words_of(text: str | None) -> list[str]:
    """The lower-cased words; texts within Latin-1 are cut by a table, which is several times as fast."""
    low = text.lower() if text else ""
    try:
        return low.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


class Places(dict):
    """Each word's place in the order in which words were first asked for."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place

    def of(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


@dataclass
class Example:
    """A labelled text: its distinct words' buckets, which of them stands where, and its class."""

    lang: str | None
    toxic: int
    parts: np.ndarray
    at: np.ndarray
    fold: int = 0


def having_of(examples: list[Example]) -> np.ndarray:
    """(class, vector): documents that hold a vector; those of all documents at place 0."""
    having = np.zeros((2, BUCKETS), dtype=np.int64)
    for e in examples:
        having[e.toxic, np.unique(e.parts)] += 1
    having[:, 0] = np.bincount(np.array([e.toxic for e in examples], dtype=np.int64), minlength=2)
    return having


class Net:
    """Vectors, filters of several widths, pooling and a linear layer."""

    def __init__(self, examples: list[Example], seed: int, having: np.ndarray | None = None):
        """A net trained on some examples; with ``having``, of more rows than these, it starts from
        their counts."""
        rng, having = np.random.default_rng(seed), having_of(examples) if having is None else having
        totals = having[:, 0]
        self.vectors = np.zeros((BUCKETS, DIM), dtype=np.float32)
        shares = (having + 0.5) / (totals[:, None] + 1.0)
        used = having.sum(axis=0) >= min(LEAST_DOCS, totals.sum())
        used[0] = False
        self.vectors[used] = rng.normal(0, 0.05, (int(used.sum()), DIM))
        self.vectors[used, 0] = np.clip(np.log(shares[1] / shares[0]), -4, 4)[used] / PARTS
        self.unused = np.flatnonzero(~used)  # these stay zero
        self.filters = {w: rng.normal(0, 0.2, (w, DIM, n)).astype(np.float32) for w, n in WIDTHS.items()}
        for filters in self.filters.values():
            filters[:, 0, 0] += 1.0  # one filter of each width begins as the sum of its words' log ratios
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.05, (FILTERS, TOP)).astype(np.float32)
        self.out[np.cumsum([0, *WIDTHS.values()])[:-1]] += 0.3
        self.last = np.array([-1.0], dtype=np.float32)
        self.weight = np.sqrt(totals.sum() / 2 / np.maximum(totals, 1))
        for _ in range(EPOCHS if examples else 0):
            self.epoch(examples, rng)

    def _laid(self, examples: list[Example]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all distinct words (the first row is no word), the word at each place with
        empty places after each text, and each text's limits."""
        gap = max(WIDTHS) - 1
        parts = np.concatenate([np.zeros((1, PARTS), dtype=np.int64), *[e.parts for e in examples]])
        base = np.cumsum([1, *[len(e.parts) for e in examples]])
        empty = np.zeros(gap, dtype=np.int64)
        at = np.concatenate([x for e, b in zip(examples, base) for x in (e.at + b, empty)])
        sizes = np.array([len(e.at) for e in examples])
        begin = np.cumsum(sizes + gap) - sizes - gap
        return parts, at, begin, begin + sizes

    def _pooled(self, x: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, filters, TOP) largest values of each filter, largest first, and their places; -1
        and no value where a text is shorter. ``x`` has the distinct words' vectors."""
        values = np.full((len(begin), FILTERS, TOP), -np.inf, dtype=np.float32)
        places = np.full((len(begin), FILTERS, TOP), -1, dtype=np.int64)
        made = convolved_by_column(self._projection().T @ x.T, at)
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
            for j, (best, found) in enumerate(largest(made[:, a:b])):
                values[k, :, j], places[k, :, j] = found, best + a
        return values, places

    def logits_of(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias[None, :, None], 0).reshape(len(pooled), -1) @ self.out.reshape(-1) + self.last[0]

    def logits(self, examples: list[Example]) -> np.ndarray:
        found = []
        for group in _by_words(examples):
            parts, at, begin, end = self._laid(group)
            pooled, _ = self._pooled(self.words(parts), at, begin, end)
            found.append(self.logits_of(pooled))
        return np.concatenate(found) if found else np.zeros(0)

    def _params(self) -> list[np.ndarray]:
        return [self.vectors, *self.filters.values(), self.bias, self.out, self.last]

    def epoch(self, examples: list[Example], rng: np.random.Generator) -> None:
        """Once over the examples, by Adam."""
        params = self._params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = rng.permutation(len(examples))
        for t, group in enumerate(_by_words([examples[i] for i in order], BATCH), 1):
            scale = np.sqrt(0.01 / (1 - 0.99**t))  # of the second moments, whose factor 0.01 is left out
            least, rate = np.float32(1e-6 / scale), np.float32(0.01 * 0.1 / (1 - 0.9**t) / scale)  # as 0.1 of the first
            for p, g, m, v in zip(params, self._gradients(group, self.weight), first, second):
                m *= np.float32(0.9)
                m += g
                g *= g
                v *= np.float32(0.99)
                v += g
                np.sqrt(v, out=g)
                g += least
                np.divide(m, g, out=g)
                g *= rate
                p -= g
            self.vectors *= np.float32(1 - 1e-4)

    def sums(self, examples: list[Example]) -> np.ndarray:
        """The parameters, each times the number of examples behind it, and these numbers: vectors
        count by the distinct words of examples that hold them."""
        holding = np.bincount(np.concatenate([e.parts.reshape(-1) for e in examples]), minlength=BUCKETS).astype(np.float64)
        holding[0] = len(examples)
        rest = np.concatenate([p.reshape(-1) for p in self._params()[1:]]).astype(np.float64)
        return np.concatenate([(self.vectors * holding[:, None]).reshape(-1), holding, rest * len(examples)])

    def average(self, sums: np.ndarray) -> None:
        """Take the means from sums over all shards; a vector that none holds stays."""
        size = self.vectors.size
        holding = sums[size : size + BUCKETS]
        held = holding > 0
        self.vectors[held] = sums[:size].reshape(BUCKETS, DIM)[held] / holding[held, None]
        at = size + BUCKETS
        for p in self._params()[1:]:
            p[...] = (sums[at : at + p.size] / max(holding[0], 1)).reshape(p.shape)
            at += p.size

    def _gradients(self, group: list[Example], weight: np.ndarray) -> list[np.ndarray]:
        parts, at, begin, end = self._laid(group)
        x = self.words(parts)
        pooled, places = self._pooled(x, at, begin, end)
        y = np.array([e.toxic for e in group])
        p = 1 / (1 + np.exp(-np.clip(self.logits_of(pooled), -30, 30)))
        d_logit = ((p - y) * weight[y] / len(group)).astype(np.float32)
        active = np.maximum(pooled + self.bias[None, :, None], 0)
        d_out = np.tensordot(d_logit, active, axes=(0, 0))
        d_pool = d_logit[:, None, None] * self.out[None] * (active > 0)
        d_bias = d_pool.sum(axis=(0, 2))
        text, f, k = np.nonzero(d_pool)
        d, place, projection = d_pool[text, f, k], places[text, f, k], self._projection()
        # A value at a place is the sum over a filter's words; each takes the value's share.
        own = [np.flatnonzero(WIDTH[f] > j) for j in range(max(WIDTHS))]
        here = np.concatenate([at[place[o] + j] for j, o in enumerate(own)])
        column = np.concatenate([(COLUMN[f] + j * COUNT[f])[o] for j, o in enumerate(own)])
        d = np.concatenate([d[o] for o in own])[:, None]
        d_projection = added_up(column, d * x.take(here, axis=0), projection.shape[1]).T
        words, shares = sums_of(here, d * projection.T.take(column, axis=0), len(x))
        words, shares = (words[1:], shares[1:]) if len(words) and not words[0] else (words, shares)  # the first row is no word
        d_vectors = added_up(parts.take(words, axis=0).T.reshape(-1), shares, BUCKETS)
        d_vectors[self.unused] = 0
        limits = np.cumsum([w * n for w, n in WIDTHS.items()])[:-1]
        d_filters = [np.stack(np.split(g, w, axis=1)) for w, g in zip(WIDTHS, np.split(d_projection, limits, axis=1))]
        return [d_vectors, *d_filters, d_bias.astype(np.float32), d_out.astype(np.float32), np.array([d_logit.sum()], dtype=np.float32)]

    def words(self, parts: np.ndarray) -> np.ndarray:
        """Each word's sum of vectors."""
        found = self.vectors.take(parts[:, 0], axis=0)
        for k in range(1, PARTS):
            found += self.vectors.take(parts[:, k], axis=0)
        return found

    def _projection(self) -> np.ndarray:
        """(DIM, columns): the filters of each width side by side, one place in them after the other."""
        return np.concatenate([f for filters in self.filters.values() for f in filters], axis=1)

    def _projected(self, x: np.ndarray) -> np.ndarray:
        return x @ self._projection()

    def projections(self, parts: np.ndarray) -> np.ndarray:
        """What each word adds to each filter, by its place in the filter."""
        return self._projected(self.words(parts))


def sums_of(at: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places below ``size`` that occur, and the sum of each one's rows. Rows are begun again where
    there are fewer than places."""
    if not len(at):
        return at, rows
    order = np.argsort(at.astype(np.uint16) if size <= 1 << 16 else at, kind="stable")  # short keys sort by digits
    at = at.take(order)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at.take(first), np.add.reduceat(rows.take(order % len(rows), axis=0), first, axis=0)


def added_up(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows for each of ``size`` places."""
    total = np.zeros((size, rows.shape[1]), dtype=np.float32)
    places, sums = sums_of(at, rows, size)
    total[places] = sums
    return total


def convolved(added: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(filters, places): each filter over the words at some places, from what each word adds."""
    gap = max(WIDTHS) - 1
    n = max(len(at) - gap, 0)
    made = np.empty((FILTERS, n), dtype=np.float32)
    for start in range(0, n, TOGETHER):
        size, column, first = min(TOGETHER, n - start), 0, 0
        found = added.take(at[start : start + size + gap], axis=0)
        for w, count in WIDTHS.items():
            total = found[:size, column : column + count]
            for j in range(1, w):
                total = total + found[j : j + size, column + j * count : column + (j + 1) * count]
            made[first : first + count, start : start + size] = total.T
            column, first = column + w * count, first + count
    return made


def convolved_by_column(columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same from columns of what each word adds; faster where words are few, so that a column
    stays in the cache."""
    n = max(len(at) - max(WIDTHS) + 1, 0)
    made = np.empty((FILTERS, n), dtype=np.float32)
    column = first = 0
    for w, count in WIDTHS.items():
        total = made[first : first + count]
        np.take(columns[column : column + count], at[:n], axis=1, out=total, mode="clip")
        for j in range(1, w):
            total += columns[column + j * count : column + (j + 1) * count].take(at[j : n + j], axis=1, mode="clip")
        column, first = column + w * count, first + count
    return made


def largest(made: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each row's TOP largest values, largest first; they are struck out."""
    rows = np.arange(len(made))
    for _ in range(min(TOP, made.shape[1])):
        best = made.argmax(axis=1)
        yield best, made[rows, best]
        made[rows, best] = -np.inf


def _by_words(examples: list[Example], most: int = 256) -> Iterator[list[Example]]:
    """Groups of examples of bounded number and words."""
    held: list[Example] = []
    words = 0
    for e in examples:
        if held and (len(held) >= most or words + len(e.at) > TOGETHER):
            yield held
            held, words = [], 0
        held.append(e)
        words += len(e.at)
    if held:
        yield held


class Languages:
    """Naive Bayes over hashed whole words: which language a text has."""

    def __init__(self, found: dict[str, np.ndarray]):
        """``found``: how often each word stands in each language (``words_by_language``)."""
        self.names = sorted(found)
        counts = np.stack([found[n] + 0.1 for n in self.names], axis=1) if found else np.zeros((BUCKETS, 0))
        self.logs = np.log(counts / counts.sum(axis=0)).astype(np.float32) if self.names else np.zeros((BUCKETS, 0), dtype=np.float32)
        self.logs[0] = 0

    def of(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of each text's language; texts without words, or without languages, have the last number."""
        if not self.names:
            return np.zeros(len(sums), dtype=np.int64)
        return np.where(sizes > 0, np.argmax(sums, axis=1), len(self.names))

    def of_examples(self, examples: list[Example]) -> np.ndarray:
        sums = np.array([self.logs[e.parts[e.at, 0]].sum(axis=0) for e in examples]).reshape(len(examples), len(self.names))
        return self.of(sums, np.array([len(e.at) for e in examples]))


def words_by_language(examples: list[Example], found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``found`` with the words of some more examples."""
    for e in examples:
        if e.lang is not None:
            own = found.setdefault(e.lang, np.zeros(BUCKETS, dtype=np.int64))
            own += np.bincount(e.parts[e.at, 0], minlength=BUCKETS)
    return found


def best_threshold(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best weighted F1: the middle of the two logits that it parts."""
    order = np.argsort(-logits, kind="stable")
    z, hit, miss = logits[order], np.cumsum((toxic * weight)[order]), np.cumsum(((1 - toxic) * weight)[order])
    f1 = 2 * hit / np.maximum(hit + miss + hit[-1], 1e-9)
    f1[:-1][z[:-1] == z[1:]] = -1  # equal logits stay together
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1.0)


def calibrated(logits: np.ndarray, toxic: np.ndarray, langs: np.ndarray, names: int, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The threshold of each language and that of all, from logits that stand for ``rows`` rows each."""
    whole = best_threshold(logits, toxic, weight)
    found = np.full(names + 1, whole)
    for k in range(names):
        own = np.flatnonzero(langs == k)
        hits = int(rows[own] @ toxic[own])
        if PULL <= hits < rows[own].sum():
            found[k] = (hits * best_threshold(logits[own], toxic[own], weight[own]) + PULL * whole) / (hits + PULL)
    return found


class Model:
    """A net on all examples, and a threshold for each language."""

    def __init__(self, examples: list[Example], shares: tuple[float, float] = (1.0, 1.0)):
        """Learn from examples in one process. ``shares``: how many labelled documents each example
        of a class stands for."""
        toxic = np.array([e.toxic for e in examples], dtype=np.int64)
        self.fitted = bool(len(toxic)) and 0 < toxic.sum() < len(toxic)
        if not self.fitted:
            return
        self.languages = Languages(words_by_language(examples, {}))
        fold = np.zeros(len(examples), dtype=np.int64)
        for c in (0, 1):
            own = np.flatnonzero(toxic == c)
            fold[own] = np.arange(len(own)) % FOLDS
        logits = np.zeros(len(examples))
        for k in range(FOLDS):
            seen, blind = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            logits[blind] = Net([examples[i] for i in seen], 20 + k).logits([examples[i] for i in blind])
        langs = self.languages.of_examples(examples)
        self.thresholds = calibrated(logits, toxic, langs, len(self.languages.names), np.ones(len(toxic)), np.array(shares)[toxic])
        self.net = Net(examples, 20 + FOLDS)

    @classmethod
    def of(cls, net: Net, languages: Languages, thresholds: np.ndarray) -> Model:
        made = cls([])
        made.fitted, made.net, made.languages, made.thresholds = True, net, languages, thresholds
        return made

    def scores(self, logits: np.ndarray, langs: np.ndarray) -> np.ndarray:
        level = np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[langs] + level, -30, 30)))


class Scorer:
    """Scores of texts, with what each word adds remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self._forget()

    def _forget(self) -> None:
        self.known, none = Places({"": 0}), np.zeros((1, PARTS), dtype=np.int64)
        self.added, self.logs = self.model.net.projections(none), self.model.languages.logs[none[:, 0]]

    def _keep(self, name: str, rows: np.ndarray, at: int) -> None:
        """Put rows behind the first ``at`` of an array, which grows by doubling."""
        held = getattr(self, name)
        if at + len(rows) > len(held):
            held = np.concatenate([held[:at], np.empty((max(at, len(rows)), held.shape[1]), dtype=held.dtype)])
            setattr(self, name, held)
        held[at : at + len(rows)] = rows

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the words stand among those remembered; new ones are added."""
        if len(self.known) > CACHE:
            self._forget()
        before = len(self.known)
        at, new = self.known.of(words), len(self.known) - before
        if new:
            parts = buckets_of(list(islice(reversed(self.known), new))[::-1])
            self._keep("added", self.model.net.projections(parts), before)
            self._keep("logs", self.model.languages.logs[parts[:, 0]], before)
        return at

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of the words of some texts."""
        net, gap = self.model.net, max(WIDTHS) - 1
        flat = [w for words in texts for w in (*words, *[""] * gap)]
        at = self._places(flat)
        sizes = np.array([len(words) for words in texts])
        begin = np.cumsum(sizes + gap) - sizes - gap
        pooled = np.full((len(texts), FILTERS, TOP), -np.inf, dtype=np.float32)
        made = convolved(self.added, at)
        for k, (a, size) in enumerate(zip(begin.tolist(), sizes.tolist())):
            for j, (_, found) in enumerate(largest(made[:, a : a + size])):
                pooled[k, :, j] = found
        sums = np.add.reduceat(self.logs[at], begin, axis=0, dtype=np.float64) if self.model.languages.names else np.zeros((len(texts), 0))
        return self.model.scores(net.logits_of(pooled), self.model.languages.of(sums, sizes))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row per id to learn from."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_held_out())
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def _hashed(rows: DataFrame) -> DataFrame:
    """(toxic, lang, h, tie, copy, parts, at) of labelled texts (toxic, lang, h, tie, text): their
    hashed words; ``copy`` numbers equal rows within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        hashed: dict[str, bytes] = {}

        def of(batch: pa.RecordBatch, held: list[tuple[np.ndarray, Places]]) -> pa.RecordBatch:
            if len(hashed) > CACHE:
                hashed.clear()
            if new := [w for w in dict.fromkeys(chain.from_iterable(known for _, known in held)) if w not in hashed]:
                made = buckets_of(new).astype("<u2").tobytes()
                hashed.update((w, made[n : n + 2 * PARTS]) for w, n in zip(new, range(0, len(made), 2 * PARTS)))
            copies = []
            for h, tie in zip(batch.column("h").to_pylist(), batch.column("tie").to_pylist()):
                copies.append(seen[h, tie])
                seen[h, tie] += 1
            parts = pa.array([b"".join(map(hashed.__getitem__, known)) for _, known in held], pa.binary())
            at = pa.array([places.astype("<u4").tobytes() for places, _ in held], pa.binary())
            return pa.record_batch([*(batch.column(c) for c in ("toxic", "lang", "h", "tie")), pa.array(copies, pa.int64()), parts, at], names=["toxic", "lang", "h", "tie", "copy", "parts", "at"])

        for batch in batches:
            held, first, count = [], 0, 0
            for n, text in enumerate(batch.column("text")):
                words, known = words_of(text.as_py()), Places()
                held.append((known.of(words), known))
                count += len(words)
                if count >= TOGETHER or n + 1 == batch.num_rows:
                    yield of(batch.slice(first, n + 1 - first), held)
                    held, first, count = [], n + 1, 0

    return rows.mapInArrow(run, "toxic int, lang string, h long, tie long, copy long, parts binary, at binary")


def _example(lang: str | None, toxic: int, parts: bytes, at: bytes, fold: int = 0) -> Example:
    return Example(lang, toxic, np.frombuffer(parts, dtype="<u2").astype(np.int64).reshape(-1, PARTS), np.frombuffer(at, dtype="<u4").astype(np.int64), fold)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", F.lit(11)).alias("h"), F.xxhash64("text").alias("tie")]


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, most: int = MOST_WORDS) -> DataFrame:
    """(toxic, lang, h, tie, parts, at): the hashed words of a trial's sample, the labelled documents
    of each class with the least hashes. The registered query learns from all: ``examples_of``."""
    known = labelled(labels).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    counts = known.groupBy("toxic").agg(F.count("*").alias("n"))  # two rows
    near = known.join(F.broadcast(counts), "toxic").where(likely_least(F.col("h"), per_class, F.col("n")))
    # 2 x per_class rows of three numbers at most: broadcast, so that no text is shuffled.
    picked = saved(least_hashed(near.select("doc_id", "toxic", "h"), "toxic", per_class, "h", "doc_id"), "toxic-ids")
    rows = _texts(docs).join(F.broadcast(picked.drop("h")), "doc_id").select("toxic", "lang", *_keys(), "text")
    made = saved(least_hashed(_hashed(rows).drop("copy"), "toxic", per_class, "h", "tie"), "toxic-sample")  # an id may have many texts
    so_far = Window.partitionBy("toxic").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("at") / 4).over(so_far), F.lit(0))
    return made.withColumn("_before", before).where(F.col("_before") < most / 2).drop("_before")


def near_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` without most rows that have no label: those whose id's hash no labelled id has, by a
    bitmap of 2^FILTER_BITS bits, a size that does not depend on the labels. It spares shuffling their
    texts; what passes is joined exactly."""

    def hashed(rows: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << FILTER_BITS)) + 1
        return rows.withColumns({"_block": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})

    # Ids are shuffled, not bitmaps.
    bits = hashed(known).select("_block", "_bit").repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_bit DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    rows, held = hashed(docs), saved(bits.withColumnRenamed("_block", "_of"), "toxic-bitmap")
    met = (F.col("_block") == F.col("_of")) & (F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    return rows.join(F.broadcast(held), met, "left_semi").drop("_block", "_bit")


def examples_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, toxic, lang, fold, parts, at): the hashed words of all labelled rows, as a table whose
    files are shards in the order of hashes."""
    known = saved(labelled(labels), "toxic-known")
    shards = max(1, -(-known.count() // SHARD))
    rows = spread_join(near_labelled(_texts(docs).where(~_held_out()), known), known, "doc_id", "toxic", "inner").select("toxic", "lang", *_keys(), "text")
    dealt = _hashed(rows).withColumn("shard", F.pmod(F.xxhash64("tie", "copy", "h"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "tie", "copy")
    return saved(dealt.select("shard", "toxic", "lang", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "parts", "at"), "toxic-examples")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Example]]:
    """The examples of each shard, of long ones a bounded number together."""
    held: list[Example] = []
    words, last = 0, None
    for batch in batches:
        for shard, toxic, lang, fold, parts, at in zip(*(batch.column(c).to_pylist() for c in ("shard", "toxic", "lang", "fold", "parts", "at"))):
            if held and (shard != last or len(held) >= SHARD_ROWS or words + len(at) // 4 > SHARD_WORDS):
                yield held
                held, words = [], 0
            held.append(_example(lang, toxic, parts, at, fold))
            words, last = words + len(at) // 4, shard
    if held:
        yield held


def counts_of(examples: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(fold, class, vector): documents of all examples that hold a vector (``having_of``); and how
    often each word stands in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, words = np.zeros((FOLDS, 2, BUCKETS), dtype=np.int64), {}
        for piece in pieces(batches):
            for fold in range(FOLDS):
                having[fold] += having_of([e for e in piece if e.fold == fold])
            words_by_language(piece, words)
        for lang, kind, counts in [*((None, k, c) for k, c in enumerate(having.reshape(-1, BUCKETS))), *((lang, -1, c) for lang, c in words.items())]:
            at = np.flatnonzero(counts)
            if kind < 0 and not len(at):
                at = np.array([0])  # a language of texts without words
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "kind", "bucket", "n"])

    rows = examples.coalesce(MOST_TASKS).mapInArrow(run, "lang string, kind int, bucket int, n long")
    having, words = np.zeros((FOLDS * 2, BUCKETS), dtype=np.int64), {}
    for batch in rows.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        lang, (kind, bucket, n) = batch.column("lang").to_pylist(), (batch.column(c).to_numpy() for c in ("kind", "bucket", "n"))
        own = kind >= 0
        having[kind[own], bucket[own]] = n[own]
        for k in np.flatnonzero(~own).tolist():
            words.setdefault(lang[k], np.zeros(BUCKETS, dtype=np.int64))[bucket[k]] = n[k]
    return having.reshape(FOLDS, 2, BUCKETS), words


def _seen(piece: list[Example], k: int) -> list[Example]:
    """What net k learns from: all but fold k; the last net from all."""
    return [e for e in piece if e.fold != k]


def train_round(examples: DataFrame, nets: Sequence[Net], epoch: int) -> None:
    """Every shard trains each net once from where it stands; the nets become the shards' means."""
    sent = examples.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray | None] = [None] * len(sent.value)
        for piece in pieces(batches):
            for k, start in enumerate(sent.value):
                own, net = _seen(piece, k), deepcopy(start)
                if own:
                    net.epoch(own, np.random.default_rng([k, epoch]))
                    found = net.sums(own)
                    sums[k] = found if sums[k] is None else sums[k] + found
        for k, found in enumerate(sums):
            if found is not None:
                starts, found = range(0, len(found), BLOCK), found.astype(np.float32)
                yield pa.record_batch([pa.array([k] * len(starts), pa.int32()), pa.array(starts, pa.int32()), pa.array([found[a : a + BLOCK].tobytes() for a in starts], pa.binary())], names=["net", "start", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(found, dtype=np.float32).astype(np.float64) for found in rows.column("sums").to_pylist())
        return pa.table({"net": rows.column("net")[:1], "start": rows.column("start")[:1], "sums": pa.array([total.astype(np.float64).tobytes()], pa.binary())})

    schema = "net int, start int, sums binary"
    # Each task leaves one sum, so there are no more than keep all cores busy.
    tasks = min(MOST_TASKS, 2 * examples.sparkSession.sparkContext.defaultParallelism)
    made = examples.coalesce(tasks).mapInArrow(run, schema).groupBy("net", "start").applyInArrow(add, schema).toArrow()
    found: dict[int, list[tuple[int, bytes]]] = {}
    for k, start, part in zip(*(made.column(c).to_pylist() for c in ("net", "start", "sums"))):
        found.setdefault(k, []).append((start, part))
    for k, parts in found.items():
        nets[k].average(np.concatenate([np.frombuffer(part, dtype=np.float64) for _, part in sorted(parts)]))
    sent.unpersist()


def blind_counts(examples: DataFrame, nets: Sequence[Net], languages: Languages) -> np.ndarray:
    """(language, class, logit x GRID, rows): logits of all examples by the nets that did not see them."""
    sent = examples.sparkSession.sparkContext.broadcast((nets[:FOLDS], languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, languages = sent.value
        counts: Counter = Counter()
        for piece in pieces(batches):
            for k, net in enumerate(nets):
                own = [e for e in piece if e.fold == k]
                if own:
                    z = np.rint(np.clip(net.logits(own), -LARGEST, LARGEST) * GRID).astype(np.int64)
                    counts.update(zip(languages.of_examples(own).tolist(), [e.toxic for e in own], z.tolist()))
        columns = list(zip(*((*key, n) for key, n in counts.items()))) or [[]] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["lang", "toxic", "logit", "n"])

    rows = examples.coalesce(MOST_TASKS).mapInArrow(run, "lang long, toxic long, logit long, n long")
    made = rows.groupBy("lang", "toxic", "logit").agg(F.sum("n").alias("n")).orderBy("lang", "toxic", "logit").toArrow()
    return np.stack([made.column(c).to_numpy() for c in ("lang", "toxic", "logit", "n")], axis=1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None) -> Model:
    """The model of all labelled rows that are not held out; with ``per_class`` a trial's."""
    if per_class is not None:
        return _trial(docs, labels, per_class)
    examples = examples_of(docs, labels)
    having, words = counts_of(examples)
    if not having[:, :, 0].sum(axis=0).all():
        return Model([])
    whole, languages = having.sum(axis=0), Languages(words)
    nets = [Net([], 20 + k, whole - having[k] if k < FOLDS else whole) for k in range(FOLDS + 1)]
    for epoch in range(EPOCHS):
        train_round(examples, nets, epoch)
    found = blind_counts(examples, nets, languages)
    thresholds = calibrated(found[:, 2] / GRID, found[:, 1], found[:, 0], len(languages.names), found[:, 3], found[:, 3])
    return Model.of(nets[FOLDS], languages, thresholds)


def _trial(docs: DataFrame, labels: DataFrame, per_class: int) -> Model:
    totals = {r.toxic: r["count"] for r in labelled(labels).groupBy("toxic").count().collect()}
    rows = sorted(sampled(docs, labels, per_class).collect(), key=lambda r: (r.toxic, r.h, r.tie))
    examples = [_example(r.lang, r.toxic, r.parts, r.at) for r in rows]
    of = [sum(e.toxic == c for e in examples) for c in (0, 1)]
    return Model(examples, tuple(totals.get(c, 0) / max(1, of[c]) for c in (0, 1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value.fitted else None

        def of(rows: pa.RecordBatch, held: list[list[str]]) -> pa.RecordBatch:
            found = scorer(held).astype(np.float64) if scorer else np.zeros(len(held))
            return pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array(found), pa.array((found >= AT_THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        for batch in batches:
            held, first, count = [], 0, 0
            for n, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if held and count + len(words) > TOGETHER:
                    yield of(batch.slice(first, n - first), held)
                    held, first, count = [], n, 0
                held.append(words)
                count += len(words)
            if held:
                yield of(batch.slice(first), held)

    rows = docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
