import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import common, store
from tallyforge.llm.common import new_path
from tallyforge.llm.tokens import WORD_BPE, tokenizer_path


def slow_rows(texts):
    """texts: [(doc_id, text)] in ascending order."""
    whole, start, out = Tokenizer.from_file(tokenizer_path(WORD_BPE)), 0, []
    for doc, text in texts:
        ids = np.array([*(whole.encode(text, add_special_tokens=False).ids if text else []), 1], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, data):
    rows = store.op5(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    assert sorted(map(tuple, rows)) == slow_rows(texts)


def test_round_trip_and_verification(spark):
    long = " ".join(f"word{i % 977} other{i}" for i in range(8_000))
    texts = [(None, "x"), (1, None), (2, ""), (3, long), (4, "prefix " + long), (7, long), (7, long), (9, "A b")]
    docs = spark.createDataFrame([(d, t, b"z") for d, t in texts], "doc_id long, text string, chunk_id binary")
    folder = new_path(spark, "store-test")
    store.write(docs, folder)
    rows = store.read(spark, folder).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == slow_rows(texts)
    assert store.verify(spark, folder).count() == 0
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    stored, total = chunks.agg({"n_ids": "sum"}).first()[0], sum(r.n_tokens for r in rows)
    assert stored < 0.5 * total  # four copies of one text share their chunks
    whole = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    ids = {r.doc_id: r.ids for r in store.reconstruct(spark, folder, docs.where("doc_id IN (4, 9)")).collect()}
    assert ids == {d: [*whole.encode(t, add_special_tokens=False).ids, 1] for d, t in texts if d in (4, 9)}


def test_a_changed_chunk_is_found(spark):
    folder = new_path(spark, "store-test")
    store.write(spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string"), folder)
    chunks = spark.createDataFrame([(r.chunk_id, r.n_ids, bytes(reversed(r.payload))) for r in spark.read.parquet(f"{folder}/chunks").collect()], "chunk_id binary, n_ids int, payload binary")
    chunks.write.mode("append").parquet(f"{folder}/bad/chunks")
    with pytest.raises(Exception, match="does not hold its ids"):
        spark.read.parquet(f"{folder}/bad/chunks").select("chunk_id", "payload").mapInArrow(store._checked, "chunk_id binary, n long, crc long").collect()


@pytest.fixture(scope="module")
def tampered(spark):
    """A store, and a way to copy it with one of its tables changed."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(3_000))
    folder = new_path(spark, "store-test")
    store.write(spark.createDataFrame([(i, f"{i} {long[i * 50 :]}") for i in range(6)], "doc_id long, text string"), folder)

    def change(name, how):
        other = new_path(spark, "store-test")
        for part in ("chunks", "recipes", "manifest"):
            rows = spark.read.parquet(f"{folder}/{part}")
            (how(rows) if part == name else rows).write.parquet(f"{other}/{part}")
        return other

    return change


SWAPPED = "CASE WHEN doc_id = 3 THEN concat(substr(chunk_ids, 17, 16), substr(chunk_ids, 1, 16), substr(chunk_ids, 33)) ELSE chunk_ids END"
LOST = "CASE WHEN doc_id = 2 THEN substr(chunk_ids, 17) ELSE chunk_ids END"


@pytest.mark.parametrize(
    ("name", "how"),
    [
        ("recipes", lambda x: x.withColumn("chunk_ids", F.expr(SWAPPED))),
        ("recipes", lambda x: x.withColumn("chunk_ids", F.expr(LOST))),
        ("recipes", lambda x: x.where("doc_id <> 5")),
        ("recipes", lambda x: x.withColumn("doc_id", F.col("doc_id") + 1)),
        ("manifest", lambda x: x.withColumn("before", F.col("before") + 1)),
        ("manifest", lambda x: x.withColumn("root", F.reverse("root"))),
        ("manifest", lambda x: x.where("part < 0")),
    ],
    ids=["swapped", "dropped chunk", "dropped document", "renamed", "moved", "root", "no part"],
)
def test_a_changed_store_is_not_read(spark, tampered, name, how):
    with pytest.raises(ValueError, match="manifest's roots"):
        store.read(spark, tampered(name, how))


def test_a_lost_chunk_is_an_error(spark, tampered):
    folder = tampered("chunks", lambda x: x.orderBy("chunk_id").offset(1))
    with pytest.raises(Exception, match="chunks are missing"):
        store.read(spark, folder).collect()


def test_a_chunk_that_many_documents_share(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    shared = " ".join(f"word{i % 977} other{i}" for i in range(1_500))
    texts = [(i, f"{i} {shared}" if i % 3 == 0 else f"own words {i}") for i in range(120)]
    folder = new_path(spark, "store-test")
    store.write(spark.createDataFrame(texts, "doc_id long, text string"), folder)
    assert sorted(map(tuple, store.read(spark, folder).collect())) == slow_rows(texts)


def test_empty_table(spark):
    folder = new_path(spark, "store-test")
    store.write(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert store.read(spark, folder).count() == 0 and store.verify(spark, folder).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(2, 49_000, 20_000).astype(np.uint32)
    longer = np.append(np.uint32(7), ids)
    ends, moved = (store.cuts(0, len(x), store.places(x).tolist()) for x in (ids, longer))
    behind = store.cuts(1, len(ids), store.places(longer).tolist())  # the same ids, behind another text
    assert [e - 1 for e in behind] == ends
    assert ends[-1] == 20_000 and np.diff([0, *ends]).max() <= store.MOST
    assert len({e + 1 for e in ends} & set(moved)) > 0.8 * len(ends)
