import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tallyforge.llm import mixing, rules

from tests.llm.test_packing import BYTE_BPE, library
from tests.llm.test_pii import slow_base
from tests.llm.test_simhash import slow_classes, slow_print


def test_stages_one_by_one(spark, data, tmp_path):
    """Each stage's rows against a plain version of its rule on the stage's own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(i)))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / str(i))))
        docs = seen[name][1]
        if i < 4:
            assert docs.columns == seen[name][0].columns

    before, after = (t.collect() for t in seen["quality rules"])
    judged = {r.doc_id: r.kept for r in rules.op2(spark, data).collect()}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if judged[r.doc_id])
    before, after = (t.collect() for t in seen["near dedup"])
    classes = slow_classes({r.doc_id: slow_print(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in seen["personal data"])
    assert before.keys() == after.keys() and not any(slow_base(t) for t in after.values())
    changed = [d for d in before if before[d] != after[d]]
    assert changed and all(before[d] == after[d] for d in before if not slow_base(before[d]) and "token" not in before[d].lower())
    before, after = (t.collect() for t in seen["mixing"])
    copies = Counter(r.doc_id for r in after)
    wanted = {r.doc_id: r["_mix"].copies for r in mixing.mix(seen["mixing"][0]).collect()}
    assert copies == wanted and set(copies) <= {r.doc_id for r in before}
    texts, counts = {r.doc_id: r.text for r in after}, defaultdict(int)
    rows = seen["packing"][1].collect()
    for r in rows:
        counts[r.doc_id] += r.length
    assert set(counts) == set(copies)
    assert all(counts[r.doc_id] == copies[r.doc_id] * r.doc_tokens for r in rows)
    # Every copy is packed whole: its pieces share a row.
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.row_id].append(r)
    assert Counter(pieces[0].doc_id for pieces in by_row.values()) == copies
    whole = library(BYTE_BPE)
    for pieces in by_row.values():
        ids = np.array([*whole.encode(texts[pieces[0].doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_run_equals_the_stages(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert max(sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}) <= 1024


LONG = " ".join(f"word{i % 613} and other{i % 271} words of plain text" for i in range(200))
ODD = [
    (1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, "b", 2), (None, LONG, "en", None, 5, None, None), (None, LONG, "en", None, 5, None, None),
    (3, LONG + " tail", None, "s", 5, "c", 3), (4, LONG[::-1], "en", "s", 5, "d", 4), (4, "mail a.b@mail.com " + LONG.upper().lower()[50:], "en", "s", 5, "e", 5),
    (5, " ".join(f"own{i} text{i * 7 % 991} of{i % 37} five{i % 19}" for i in range(40_000)), "en", "t", 5, "f", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _place int"


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_take_odd_rows(spark, data, tmp_path, rows):
    """Nulls in any column, empty and very long texts, repeated rows, two texts under one id,
    extra columns with the names that operators use, and the empty table, through every stage."""
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    docs, kept = spark.read.parquet(str(tmp_path / "in")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(i)))
        kept[name] = spark.read.parquet(str(tmp_path / str(i))).collect()
        assert i == 4 or out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / str(i)))
    if not rows:
        assert not any(kept.values())
        return
    assert {(r.doc_id, r._row) for r in kept["quality rules"]} <= {(r[0], r[5]) for r in rows[2:]}
    deduped = kept["near dedup"]
    assert len(deduped) < len(kept["quality rules"]) and {r.doc_id for r in deduped} >= {4, 5}
    assert all("a.b@mail.com" not in r.text for r in kept["personal data"]) and len(kept["personal data"]) == len(deduped)
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mixing"]}
