from collections import Counter

import duckdb
import pytest

from tallyforge.llm import entries, rules

SCHEMA = "doc_id long, text string, kept string, failed int"


def slow_row(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text, plainly."""
    space = " \t\n\v\f\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in space:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in (text or "").split("\n") if x.strip(space)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "w " * 40, "line one\nline one\n \n\nline one",
    "  no break   other", "# * $ % & | < >", "xé\U0001f600 " * 25, "a\vb\fc\rd", "UPPER CASE WORDS " * 8,
    " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i % 9}" for i in range(40)), "long " * 60_000,
]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "one", None, None), (3, "one", "x", 7)], SCHEMA)
    rows = rules.apply_policy(rules.ledger(docs)).collect()
    assert len(rows) == len(TEXTS) + 2 and sum(r.doc_id == 3 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        text = "one" if r.doc_id is None else TEXTS[r.doc_id]
        found = slow_row(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == found, r.doc_id
        assert r.base_failed == (found[0] < 20 or 100 * found[4] > 30 * found[0])
        assert not (r.base_failed and r.kept)


def test_keep_returns_rows_as_they_were(spark):
    good = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good, "a", 1), (1, good, "a", 1), (2, "short", "b", 2), (None, good, None, None), (3, None, "c", 3)], SCHEMA)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == {(1, good, "a", 1): 2, (None, good, None, None): 1}
    assert rules.keep(docs.where("false")).count() == 0


def test_ablation_from_the_ledger(spark):
    ledger = spark.createDataFrame([(0,), (0,), (1,), (5,), (4,)], "failed long")
    by = {(r.policy, r.rule): r for r in rules.ablation(ledger).collect()}
    short = by["v1", "too_short"]
    assert (short.n_failed, short.n_failed_alone, short.n_kept, short.n_kept_without) == (2, 1, 2, 3)
    assert by["base", "too_short"].n_failed_alone == 2
    assert rules.ablation(ledger.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    found = con.sql(entries.SQL[name])
    df = entries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
