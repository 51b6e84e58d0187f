"""Language identification by hierarchical discrimination.

First a linear classifier over language families, then, within the predicted family,
one-versus-one linear support vector machines whose votes separate related languages.
Features are hashed byte n-grams of the lower-cased letters of the whole text, scaled to
unit length and made where they are used; no feature table is shuffled.

The models are fitted on a bounded, documented sample: the PER_LANGUAGE labelled texts of each
language with the least hashes, over all of them; the family classifier uses at most
FAMILY_ROWS of these. What reaches the driver are their hashed counts, at most
2^BITS numbers a text, never texts.

Defined cases: a null text, or one without a letter (Unicode categories L*), is ``und`` with
score 0; rows are judged one by one, so repeated rows get equal answers; a null id is never
held out and is not learned from; without labelled rows every text with letters is ``und``;
languages that tie are taken by margin, then by name; languages outside FAMILIES form a family
of their own; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import least_hashed, likely_least, saved, table

UNKNOWN = "und"
#: Bits of a hashed n-gram.
BITS = 13
#: Labelled texts of a language that its models are fitted on, and of all languages that the
#: family classifier is fitted on, at most.
PER_LANGUAGE, FAMILY_ROWS = 600, 6_000
#: Share of 4 whose ids are held out of learning, by crc32.
HELD_OUT = 2

#: Fixed language families.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}

_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def counts(text: str) -> np.ndarray:
    """Counts of the hashed byte pairs and triples of a text, lower-cased, with ASCII other
    than letters as spaces."""
    plain = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    data = np.frombuffer(b" " + plain + b" ", dtype=np.uint8).astype(np.uint32)
    pair = data[:-1] * np.uint32(257) + data[1:]
    triple = pair[:-1] * np.uint32(65599) + data[2:] + np.uint32(0x51ED270B)
    shift, mix = np.uint32(32 - BITS), np.uint32(0x9E3779B1)
    return np.bincount(pair * mix >> shift, minlength=1 << BITS) + np.bincount(triple * mix >> shift, minlength=1 << BITS)


def _scaled(count: np.ndarray) -> np.ndarray:
    row = count.astype(np.float32)
    return row / max(1e-9, float(np.sqrt(row @ row)))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, c: float = 20.0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by accelerated
    gradient steps on all rows; classes weigh the same."""
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c).astype(np.float32)
    y, w = y.astype(np.float32), np.zeros(x.shape[1], dtype=np.float32)
    last, step = w, np.float32(1.0 / (1.0 + 2.0 * c))  # rows have unit length
    for t in range(rounds):
        ahead = w + np.float32(t / (t + 3)) * (w - last)
        slack = np.maximum(np.float32(0), 1 - y * (x @ ahead))
        last, w = w, ahead - step * (ahead - (2 * weight * slack * y) @ x)
    return w


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Weight vectors as columns of one table: families first, then pairs of languages."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]]):
        """``samples`` has (language, buckets in use, their counts) of each text."""
        by_lang: dict[str, list[int]] = {}
        for n, (lang, _, _) in enumerate(samples):
            by_lang.setdefault(lang, []).append(n)
        self.langs = sorted(by_lang)
        self.families = sorted({family(x) for x in self.langs})
        self.pairs = [(a, b) for f in self.families for i, a in enumerate(self.of(f)) for b in self.of(f)[i + 1 :]]

        def rows(langs: list[str], each: int) -> tuple[np.ndarray, np.ndarray]:
            """Scaled rows of ``each`` texts of each language at most, and their languages."""
            taken = [n for lang in langs for n in by_lang[lang][:each]]
            dense = np.zeros((len(taken), 1 << BITS), dtype=np.float32)
            for row, n in zip(dense, taken):
                row[samples[n][1]] = samples[n][2]
                row /= max(1e-9, float(np.sqrt(row @ row)))
            return dense, np.array([samples[n][0] for n in taken])

        columns = []
        if len(self.families) > 1:
            x, named = rows(self.langs, max(1, FAMILY_ROWS // len(self.langs)))
            own = np.array([family(lang) for lang in named])
            columns += [_svm(x, np.where(own == f, 1.0, -1.0)) for f in self.families]
        for a, b in self.pairs:
            x, named = rows([a, b], len(samples))
            columns.append(_svm(x, np.where(named == a, 1.0, -1.0)))
        self.weights = np.array(columns, dtype=np.float32).reshape(-1, 1 << BITS)

    def of(self, name: str) -> list[str]:
        return [x for x in self.langs if family(x) == name]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _has_letter(text):
            return UNKNOWN, 0.0
        margins = self.weights @ _scaled(counts(text))
        n = len(self.families) if len(self.families) > 1 else 0
        chosen = self.families[int(np.argmax(margins[:n]))] if n else self.families[0]
        ordered = np.sort(margins[:n])
        sure = 1.0 / (1.0 + np.exp(-2.0 * (ordered[-1] - ordered[-2]))) if n else 1.0
        members = self.of(chosen)
        votes = {x: [0, 0.0] for x in members}
        for (a, b), margin in zip(self.pairs, margins[n:]):
            if a in votes:
                for lang, m in ((a, margin), (b, -margin)):
                    votes[lang][0] += m > 0
                    votes[lang][1] += m
        best = max(members, key=lambda x: (*votes[x], x))
        if len(members) > 1:
            sure *= 1.0 / (1.0 + np.exp(-4.0 * votes[best][1] / (len(members) - 1)))
        return best, float(sure)


def learned(docs: DataFrame) -> DataFrame:
    """Rows to learn from: labelled, and not held out."""
    return docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out())


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the ``per_language`` texts of each language with the least hashes."""
    rows = learned(docs)
    # One row per language, written, so that Spark knows its size and joins it without
    # shuffling texts while it is small.
    hashed = rows.select("lang", "text", F.xxhash64("doc_id", F.lit(8)).alias("h"))
    totals = saved(hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "language-counts")
    # The least hash itself always passes: rows of one id have one hash.
    likely = likely_least(F.col("h"), per_language, F.col("n")) | (F.col("h") == F.col("least"))
    near = hashed.join(totals, "lang").where(likely).select("lang", "h", F.xxhash64("text").alias("tie"), "text")
    picked = least_hashed(near, "lang", per_language, "h", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            columns = [pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([c[x].astype("<u4").tobytes() for c, x in zip(found, at)], pa.binary())]
            yield pa.record_batch([batch.column("lang"), batch.column("h"), batch.column("tie"), *columns], names=["lang", "h", "tie", "at", "count"])

    sample = sorted(picked.mapInArrow(run, "lang string, h long, tie long, at binary, count binary").collect())
    return Model([(r.lang, np.frombuffer(r.at, dtype="<u2"), np.frombuffer(r["count"], dtype="<u4")) for r in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = sent.value.predict
        for batch in batches:
            found = [answer(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
