import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import packing, tokens
from tallyforge.llm.tokens import BYTE_BPE, WORD_BPE, encoder, tokenizer_path

ODD = ["", " ", "  a", "a  b", "a \n b", "x\n  y", "x\n\n y  z  ", "don't DON'T it's 's", "naïve café ﬁ İstanbul Σς", "a\xa0b  c",
       "<|endoftext|> x <|startoftext|>", "é é", "tab\tsep \x1c y", "日本語 12 345", "\n", "\n \n", " a", "a ", "#!!  |x| y", "µª º ×÷ \U0001f600", "x" * 5000]


@lru_cache
def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def encoded(name, words, texts, end=7):
    found = []
    for first, ids, ends in encoder(tokenizer_path(name), words).encode(pa.array(texts, pa.string()), end):
        assert first == len(found)
        found += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert all(x[-1] == end for x in found)
    return [x[:-1] for x in found]


@pytest.mark.parametrize(("name", "words"), [(BYTE_BPE, False), (WORD_BPE, True)])
def test_encoder_equals_the_library(spark, data, name, words):
    """The plain call, special tokens included; twice, so that what is kept is used."""
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    whole = Tokenizer.from_file(tokenizer_path(name))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        for text, mine, ids in zip(texts, encoded(name, words, texts), want):
            assert mine == ids, text[:60]
    assert encoded(name, words, [None, ""]) == [[], []] and encoded(name, words, []) == []


@pytest.mark.parametrize(("name", "words"), [(BYTE_BPE, False), (WORD_BPE, True)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c.,'!?-<|>éÉ×²½Ⅷ\u0301\u00a0\u2003\u3000\u200b\u201c日ﬁsStA1"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_encoder_equals_the_library_on_odd_texts(name, words, texts):
    whole = library(name)
    assert encoded(name, words, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_drops_pieces_that_came_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    whole, mine = Tokenizer.from_file(tokenizer_path(BYTE_BPE)), tokens.Encoder(tokenizer_path(BYTE_BPE), False)
    for k in range(12):
        texts = [f"the common words word{k}a{i} and other{i} 日本{k}." for i in range(9)]
        for _, ids, ends in mine.encode(pa.array(texts), 0):
            assert [x[:-1].tolist() for x in np.split(ids, ends[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert mine.held < 200


def verify(rows, texts):
    """texts: doc_id -> text; every id lies in one piece, checksums and offsets hold."""
    whole = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array([*(whole.encode(text, add_special_tokens=False).ids if text else []), 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    return padding, len(by_seq)


def test_query_packs_every_id(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    padding, n = verify(packing.op3(spark, data).collect(), texts)
    assert padding < 1024 + 16 * n


def test_copies_of_one_length_are_cut(spark):
    docs = spark.createDataFrame([(i, "word " * 600) for i in range(200)], "doc_id long, text string")
    padding, n = verify(packing.packed(docs).collect(), {i: "word " * 600 for i in range(200)})
    assert padding < 1024 + 16 * n


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "a b", 3), (3, "a b", 3), (None, "x", 3), (4, "y " * 40_000, 3), (5, "a <|endoftext|> b", 3)], "doc_id long, text string, start long")
    rows = packing.packed(docs).collect()
    counts = Counter(r.doc_id for r in rows)
    assert counts[1] == counts[2] == counts[None] == 1 and counts[3] == 2
    assert len({r.row_id for r in rows}) == len({(r.row_id, r.doc_id) for r in rows}) == 8 - 1
    verify(packing.packed(docs.where("doc_id > 3")).collect(), {4: "y " * 40_000, 5: "a <|endoftext|> b"})
    assert packing.packed(docs.where("false")).count() == 0


def test_best_fill_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        capacity = rng.randint(1, 60)
        best = max(
            s for ks in product(*[range(c + 1) for c in counts.values()]) if (s := sum(k * n for k, n in zip(ks, counts))) <= capacity
        )
        fill = packing.best_fill(counts, capacity)
        assert sum(n * k for n, k in fill.items()) == best and all(k <= counts[n] for n, k in fill.items())


def test_shifted_checksums():
    a, b = b"some prefix", b"and the rest of it"
    assert zlib.crc32(a + b) == packing.shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b)
