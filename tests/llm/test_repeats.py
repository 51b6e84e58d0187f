import hashlib
import random
import re
import zlib

import numpy as np

from tallyforge.llm import repeats


def brute_runs(words, least_words=6, least_periods=4):
    """(start, length, period): for every period, stretches whose words repeat, by comparing all."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least_words, least_periods * p))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 2, 5, 12, 40, 90]), rng.choice([1, 2, 3, 5])
            words = [str(rng.randrange(k)) for _ in range(n)]
            if n and rng.random() < 0.5:
                q = rng.randint(1, max(1, n // 4))
                words = words[:3] + [words[i % q] for i in range(n)] + words[-2:]
            texts.append(words)
        for limits in ((6, 4), (2, 2)):
            got = [[] for _ in texts]
            for of, *run in zip(*repeats.runs_of(texts, *limits)):
                got[of].append(tuple(map(int, run)))
            assert got == [brute_runs(words, *limits) for words in texts]


def test_every_square_of_a_fibonacci_word():
    """Fibonacci words have many overlapping runs of low exponent."""
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    got = sorted((int(s), int(z), int(p)) for _, s, z, p in zip(*repeats.runs_of([list(b)], 2, 2)))
    assert got == brute_runs(list(b), 2, 2) and len(got) > 100


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, z, p in runs for i in range(s + p, s + z)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    short = {r.doc_id for r in docs.where("char_length(text) < 12000").select("doc_id").collect()}
    rows = {r.doc_id: tuple(r) for r in repeats.op13(spark, data).collect()}
    assert len(rows) == docs.count()
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect() if r.doc_id in short}
    assert len(want) > 150 and all(rows[d] == w for d, w in want.items())
    assert sum(r[1] > 0 for r in want.values()) > 10


def test_odd_rows_and_clashing_names(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, " \n\t ", "x"), (3, "a a a a a a a b", "x"), (3, "a a a a a a a b", "x"), (4, "é ü " * 9, None), (None, "z " * 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = repeats.find(docs).collect()
    assert len(found) == len(rows) and found[0].runs == [] and found[1].runs == []
    assert [tuple(r) for r in found[3].runs] == [(0, 7, 1)] == [tuple(r) for r in found[4].runs]
    assert [tuple(r) for r in found[5].runs] == [(0, 18, 2)] and [tuple(r) for r in found[6].runs] == [(0, 7, 1)]
    cut = repeats.collapse(docs).collect()
    assert [r.text for r in cut] == [None, "", " \n\t ", "a b", "a b", "é ü", "z"] and [r.runs for r in cut] == [r[2] for r in rows]
    got = sorted(map(tuple, repeats.digests(docs.select("doc_id", "text")).collect()), key=str)
    assert got == sorted((brute_row(d, t) for d, t, _ in rows), key=str)
    assert repeats.digests(docs.where("false")).count() == 0 and repeats.find(docs.where("false")).count() == 0


def test_long_texts_and_groups_of_rows(spark, monkeypatch):
    """A text of one word 200,000 times, and one with a period of 1,000; rows in any grouping agree."""
    texts = [["w"] * 200_000, [str(i % 1_000) for i in range(50_000)]]
    of, start, length, period = repeats.runs_of(texts)
    assert list(zip(of.tolist(), start.tolist(), length.tolist(), period.tolist())) == [(0, 0, 200_000, 1), (1, 0, 50_000, 1_000)]
    docs = spark.createDataFrame([(i, " ".join(["x y"] * (i % 9) + [str(i)])) for i in range(60)], "doc_id long, text string")
    whole = sorted(map(str, repeats.digests(docs).collect()))
    monkeypatch.setattr(repeats, "TOGETHER", 1)
    first, held = zip(*repeats._groups(__import__("pyarrow").array([r.text for r in docs.collect()])))
    assert len(held) > 30 and list(first) == np.cumsum([0, *[len(h) for h in held[:-1]]]).tolist()
    assert sorted(map(str, repeats.digests(docs).collect())) == whole
