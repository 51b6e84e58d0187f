from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import common, simhash
from tallyforge.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_print(text):
    table = {i: i + 32 for i in range(65, 91)}
    for c in "\t\n\x0b\x0c\r":
        table[ord(c)] = " "
    words = [w for w in (text or "").translate(table).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints):
    """prints: doc_id -> fingerprint; all pairs."""
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_query_equals_brute_force(spark, data):
    rows = simhash.op7(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == slow_classes(prints)


def test_large_groups_are_tiled(spark):
    """Many fingerprints a few bits from one another, with a tile so small that every path is used."""
    rng = np.random.default_rng(5)
    base, prints = int(rng.integers(0, 1 << 62)), {}
    for d in range(600):
        fp = base if d % 3 else int(rng.integers(0, 1 << 62))
        for b in rng.choice(64, size=int(rng.integers(0, 6)), replace=False):
            fp ^= 1 << int(b)
        prints[d] = fp
    signed = [(d, fp - (1 << 64) if fp >= 1 << 63 else fp) for d, fp in prints.items()]
    rows = simhash.cluster(spark.createDataFrame(signed, "doc_id long, fp long"), tile=16).collect()
    assert {r.doc_id: r.component_id for r in rows} == slow_classes(prints)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "x", "s", 0), (3, " \n ", None, None, None), (4, "A b", None, None, None),
         (5, "a  B", None, None, None), (5, "a  B", None, None, None), (None, "a b", None, None, None), (6, "w " * 50_000, None, None, None)],
        SCHEMA,
    )
    clustered = simhash.cluster(simhash.fingerprints(docs)).collect()
    by = defaultdict(set)
    for r in clustered:
        by[r.doc_id].add(r.component_id)
    assert len(clustered) == 8 and by[1] == by[2] == by[3] == {1} and by[4] == by[5] == by[None] == {4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6"]
    assert simhash.cluster(simhash.fingerprints(docs.where("false"))).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7, 8), (2, "a b c d e", 9, 9)], "doc_id long, text string, fp long, component_id long")
    kept = simhash.keep_one(docs).collect()
    assert [tuple(r) for r in kept] == [(1, "a b c d e", 7, 8)]


def test_rows_without_an_id_link_others(spark):
    rows = simhash.cluster(spark.createDataFrame([(1, 0), (None, 0x0F), (2, 0xFF), (None, -1)], "doc_id long, fp long")).collect()
    assert {(r.doc_id, r.fp): r.component_id for r in rows} == {(1, 0): 1, (None, 0x0F): 1, (2, 0xFF): 1, (None, -1): None}


def test_texts_under_one_id_are_told_apart(spark, tmp_path):
    """Of rows (7, x), (7, y), (8, y), (null, z): y's class has ids 7 and 8 and keeps 7."""
    texts = {k: " ".join(f"{k}{i % 977} other{i}" for i in range(300)) for k in "xyz"}
    rows = [(7, texts["x"], 1), (7, texts["y"], 2), (8, texts["y"], 3), (None, texts["z"], 4), (None, texts["z"], 4)]
    spark.createDataFrame(rows, "doc_id long, text string, _place long").write.parquet(str(tmp_path / "docs"))
    kept = simhash.keep_one(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert sorted((r.doc_id or 0, r.text[0], r._place) for r in kept) == [(0, "z", 4), (7, "x", 1), (7, "y", 2)]


def test_a_third_of_all_rows_on_one_key(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = np.random.default_rng(7)
    prints = {d: 5 if d % 3 == 0 else int(rng.integers(0, 1 << 62)) ^ d % 2 for d in range(300)}
    rows = simhash.cluster(spark.createDataFrame(list(prints.items()), "doc_id long, fp long")).collect()
    assert len(rows) == 300 and {r.doc_id: r.component_id for r in rows} == slow_classes(prints)


def test_components_of_hot_nodes(spark, monkeypatch):
    """Two stars of hundreds of links, joined by a path, whose centres are not their least nodes."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    pairs = [(1000, i) for i in range(1, 300)] + [(2000, i) for i in range(400, 700)] + [(1000, 900), (900, 2000), (5000, 5001)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(found) == 299 + 300 + 3 + 2
    assert all(c == (5000 if n >= 5000 else 1) for n, c in found.items())


def test_components_of_a_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(links).where("component <> 0").count() == 0
    assert components(links).count() == 301
