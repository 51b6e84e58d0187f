import random
import re
from collections import Counter

import duckdb
import numpy as np

from tallyforge.llm import common, phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, support=10, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, total = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        inside = {q for p, a in kept.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * counts[q]}
        scored = []
        for p, a in kept.items():
            if p not in inside:
                cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def made(rng, n=400):
    words = ["A", "b", "Cé", "d", "ü", "f", "g-h", "I"]
    rows = []
    for i in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "! ", " .", "\x0b", " "]) for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(parts) + rng.choice(["", "one Two three", "one two three four"]), rng.choice(["en", "de", None, "und"])))
    return rows


def test_equals_brute_force(spark):
    rows = made(random.Random(2)) + [(None, None, "en"), (7, "", None), (7, "a b " * 3_000, "xx"), (8, "same text here", "de"), (8, "same text here", "de")] + [(9, "hot hot hot", "en")] * 150
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", common.F.lit("x"))
    for first in (2000, 5):
        got = sorted(map(tuple, phrases.phrases(docs, first=first).collect()))
        assert got == brute(rows, first=first) and len(got) > 10
    assert phrases.phrases(docs.where("false")).count() == 0


def test_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = con.sql(phrases.OP12_SQL)
    rows = phrases.op12(spark, data).collect()
    assert sorted(tuple(r[c] for c in found.columns) for r in rows) == sorted(found.fetchall()) and len(rows) > 100


def test_mining_loses_nothing(spark):
    """Every phrase with the support is in the union, however its occurrences fall on shards; all of
    one shard's phrases below the local support are not."""
    rng = random.Random(8)
    rows = [(i, f"x{rng.randrange(60)} y{rng.randrange(9)} z", "en") for i in range(900)]
    texts = phrases.texts_of(spark.createDataFrame(rows, SCHEMA))
    held, tables = phrases.locally_frequent(texts)
    union = {r.key for t in tables for r in t.collect()}
    bits = np.unpackbits(np.frombuffer(held, dtype=np.uint8), bitorder="little")
    assert set(np.flatnonzero(bits).tolist()) == {(k & (1 << 64) - 1) >> (64 - phrases.FILTER_BITS) for k in union}
    langs = np.array([r.lang_hash for r in texts.limit(1).collect()]).astype(np.int64).astype(np.uint64)
    counts = Counter(" ".join(t.split()[i : i + n]) for _, t, _ in rows for n in (1, 2, 3) for i in range(4 - n))
    for phrase, count in counts.items():
        words = phrases.cut([phrase.encode()])
        key = int((phrases.keys(words, langs)[phrase.count(" ")][1][0] & np.uint64(~7 & (1 << 64) - 1)).astype(np.int64))
        assert key in union if count >= 10 else key not in union or count > 1
    assert len(union) < len(counts)


def test_tasks_pass_counts_on(spark, monkeypatch):
    """The same rows with small slices and small holds, and with every key hot."""
    rows = made(random.Random(4), 200)
    want = brute(rows)
    monkeypatch.setattr(phrases, "TOGETHER", 50)
    monkeypatch.setattr(phrases, "HELD", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    held = phrases._Counts(20)
    parts = [p for k in range(40) for p in held.add(np.arange(k, k + 15, dtype=np.uint64))] + list(held.rest())
    assert len(parts) > 2 and sum(int(c.sum()) for _, c in parts) == 600
    assert sorted(map(tuple, phrases.phrases(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())) == want


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 9 * 10**12), ("en", 1, "b", 8 * 10**12), ("en", 2, "a b", 7 * 10**12)], "lang string, words int, phrase string, f long")
    (r,) = phrases.scored(counts).collect()
    assert r.score == 1000000 * (7 * 10**12) ** 2 // (72 * 10**24)
