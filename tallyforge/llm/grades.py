"""Quality grades by ordinal cumulative-link regression over hashed text.

Grades are ordered: 0 poor, 1 well formed but toxic, 2 good. One weight vector over hashed
words and a few shape counts is shared by all grades; ordered thresholds cut its score,
P(grade > k) = logistic(score - threshold k). A document gets its expected grade and the tail
probability of the best grade, which selects.

The model is fitted on a bounded, documented sample: the SAMPLE labelled documents of each
grade with the least hashes, over all labels. Features are made on the executors; only sparse
rows of the sample reach the driver, 8 bytes for each distinct word and MOST_FEATURES in all at
most (rows beyond that are left out of the sample, in the order of their hashes).

Defined cases: a null or wordless text gets the grades of the intercept alone; an id with
several labels counts once, by its lowest grade; a labelled id of several texts gives several
rows of the sample; labels without a quality are not learned from; null ids are predicted;
repeated rows get equal answers; without labels the expected grade is null and nothing is kept;
further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import least_hashed, likely_least, saved, table

GRADES = 3
SIZE = 1 << 16
SHAPES = 8
#: Labelled documents of a grade that the model is fitted on, and their features in all, at most.
SAMPLE, MOST_FEATURES = 4_000, 12_000_000
#: Most hashed words a worker's cache may hold before it is emptied.
CACHE = 500_000
#: Documents of the sample that have a bucket, at least, for it to count.
LEAST_DOCS = 6
#: Texts whose features are laid out together.
TOGETHER = 512

_EDGES, _LETTER = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[^\W\d_]")


class Hasher:
    """Sparse features of a text: buckets of its words, and shape counts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        import xxhash

        found = self.known.get(word)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            # The whole word, without signs at its ends; words without letters apart from the others.
            core = _EDGES.sub("", word.lower()) if _LETTER.search(word) else "#" + word
            found = xxhash.xxh32_intdigest(core) % (SIZE - SHAPES) + SHAPES
            self.known[word] = found
        return found

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and their values, text after text, and how many each text has: the shape
        counts and its distinct buckets, or the intercept alone."""
        get, slow = self.known.get, self.bucket
        split = [text.split() if text else [] for text in texts]
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        hashed = np.array([get(w) or slow(w) for words in split for w in words], dtype=np.int64)
        # Distinct buckets of each text, counted by one sort of all.
        keys, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * SIZE + hashed, return_counts=True)
        of, at = keys // SIZE, keys % SIZE
        value = np.minimum(1.0 + np.log(counts), 3.0) / np.sqrt(np.log(sizes[of] + 1.0) * 8.0)
        distinct = np.bincount(of, minlength=len(texts))
        most = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(most, of, counts)
        filled = np.flatnonzero(sizes)
        n = sizes[filled].astype(np.float64)
        letters, signs, upper, repeated = (np.zeros(len(filled)) for _ in range(4))
        for k, i in enumerate(filled.tolist()):
            text, words = texts[i], split[i]
            letters[k] = sum(map(len, words))
            signs[k] = sum(map(text.count, "#*$%&|<>"))
            upper[k] = sum(map(str.isupper, words))
            lines = text.split("\n")
            repeated[k] = 1.0 - len(set(lines)) / len(lines)
        shapes = np.column_stack((
            np.ones(len(filled)), np.minimum(1.0, signs / n), upper > 0.5 * n, 1.0 - distinct[filled] / n,
            most[filled] / n, repeated, np.minimum(1.0, letters / n / 20.0), np.minimum(1.0, 20.0 / n),
        ))
        empty = np.flatnonzero(sizes == 0)
        owner = np.concatenate((np.repeat(filled, SHAPES), empty, of))
        order = np.argsort(owner, kind="stable")
        at = np.concatenate((np.tile(np.arange(SHAPES), len(filled)), np.zeros(len(empty), dtype=np.int64), at))
        value = np.concatenate((shapes.ravel(), np.ones(len(empty)), value))
        return at[order], value[order], np.bincount(owner, minlength=len(texts))


class Model:
    """Shared weights with ordered thresholds, by Adam on the cumulative-link likelihood.

    Thresholds are a first one and positive gaps, so they stay ordered. Buckets that few of the
    sample's documents have are left out; the others are scaled by how far grades part on them
    (the log ratio of the shares of documents that have them, below and above a threshold)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], rounds: int = 300, ridge: float = 5e-5):
        self.weights, self.cuts = np.zeros(SIZE), np.zeros(GRADES - 1)
        self.fitted = bool(rows)
        if not rows:
            return
        of = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        at, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        y = np.asarray(grades)
        scale = self._scale(of, at, y)
        used = scale[at] > 0
        of, at, value = of[used], at[used], (value * scale[at])[used]
        counts = np.bincount(y, minlength=GRADES)
        share = (1.0 / np.sqrt(np.maximum(counts, 1)))[y]  # rare grades weigh more, not as much as all
        share /= share.sum()
        params = np.concatenate((self.weights, [-1.0], np.full(GRADES - 2, np.log(2.0))))
        m, v = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, rounds + 1):
            w, cuts = params[:SIZE], self._cuts(params[SIZE:])
            score = np.bincount(of, weights=w[at] * value, minlength=len(rows))
            edges = np.concatenate(([-np.inf], cuts, [np.inf]))
            high, low = _logistic(edges[y + 1] - score), _logistic(edges[y] - score)
            p = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / p * share, low * (1 - low) / p * share
            d_score = d_high - d_low  # of minus the log-likelihood
            gradient = np.zeros_like(params)
            gradient[:SIZE] = np.bincount(at, weights=value * d_score[of], minlength=SIZE) + ridge * w
            d_cut = np.array([-d_high[y == k].sum() + d_low[y == k + 1].sum() for k in range(GRADES - 1)])
            gradient[SIZE] = d_cut.sum()
            for k in range(1, GRADES - 1):
                gradient[SIZE + k] = d_cut[k:].sum() * np.exp(params[SIZE + k])
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            params -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.cuts = (params[:SIZE] * scale).astype(np.float32), self._cuts(params[SIZE:])

    @staticmethod
    def _scale(of: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Scale of each bucket; shape counts keep theirs."""
        having = np.array([np.bincount(at[y[of] == k], minlength=SIZE) for k in range(GRADES)], dtype=np.float64)
        docs = np.bincount(y, minlength=GRADES)
        scale = np.zeros(SIZE)
        for k in range(GRADES - 1):
            low, high = slice(k, k + 1), slice(k + 1, GRADES)
            shares = [(having[part].sum(axis=0) + 1.0) / (docs[part].sum() + 2.0) for part in (low, high)]
            scale = np.maximum(scale, np.abs(np.log(shares[0] / shares[1])))
        scale[having.sum(axis=0) < min(LEAST_DOCS, len(y))] = 0.0
        scale[:SHAPES] = 1.0
        return scale

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))

    def tails(self, at: np.ndarray, value: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text for each threshold k, as one sparse product."""
        score = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=self.weights[at] * value, minlength=len(lengths))
        return _logistic(score[:, None] - self.cuts)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): one row per labelled id."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch of a bounded number of texts."""
    for at in range(0, batch.num_rows, TOGETHER):
        some = batch.slice(at, TOGETHER)
        yield some, some.column(column).to_pylist()


def sampled(docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE, most: int = MOST_FEATURES) -> DataFrame:
    """(grade, h, tie, at, value): sparse rows of the sample that a model is fitted on."""
    rated = graded(labels).withColumn("h", F.xxhash64("doc_id", F.lit(1)))
    counts = rated.groupBy("grade").agg(F.count("*").alias("n"))  # a row per grade
    near = rated.join(F.broadcast(counts), "grade").where(likely_least(F.col("h"), per_grade, F.col("n")))
    # GRADES x per_grade rows of three numbers at most, whatever the corpus: broadcast, so that
    # no text is shuffled to find the sample's.
    picked = saved(least_hashed(near.select("doc_id", "grade", "h"), "grade", per_grade, "h", "doc_id"), "graded-ids")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select("grade", "h", F.xxhash64("text").alias("tie"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for some, texts in _runs(batch, "text"):
                at, value, lengths = hasher.features(texts)
                cut = np.concatenate(([0], np.cumsum(lengths)))
                parts = list(zip(cut.tolist(), cut[1:].tolist()))
                columns = [pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (at.astype("<u4"), value.astype("<f4"))]
                yield pa.record_batch([*(some.column(c) for c in ("grade", "h", "tie")), *columns], names=["grade", "h", "tie", "at", "value"])

    made = rows.mapInArrow(run, "grade int, h long, tie long, at binary, value binary")
    # A labelled id may have any number of texts; the sample is bounded again.
    made = saved(least_hashed(made, "grade", per_grade, "h", "tie"), "graded-sample")
    so_far = Window.partitionBy("grade").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("at") / 4).over(so_far), F.lit(0))
    return made.withColumn("_before", before).where(F.col("_before") < most / GRADES).drop("_before")


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE) -> Model:
    sample = sorted(sampled(docs, labels, per_grade).collect())
    features = [(np.frombuffer(r.at, dtype="<u4").astype(np.int64), np.frombuffer(r.value, dtype="<f4").astype(np.float64)) for r in sample]
    return Model(features, [r.grade for r in sample])


def grade(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_above_0, p_above_1, kept) of every row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(), sent.value
        for batch in batches:
            for some, texts in _runs(batch, "text"):
                tails = model.tails(*hasher.features(texts))
                expected = pa.array(tails.sum(axis=1), mask=np.full(len(tails), not model.fitted))
                yield pa.record_batch(
                    [some.column("doc_id"), expected, pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array((tails[:, 1] >= least) & model.fitted)],
                    names=["doc_id", "expected_grade", "p_above_0", "p_above_1", "kept"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_above_0 double, p_above_1 double, kept boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))
