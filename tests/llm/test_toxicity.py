import random
import zlib

import numpy as np
import pytest

from tallyforge.llm import toxicity as tox

SCHEMA = "doc_id long, text string, lang string"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def example(text, toxic=0, lang="en"):
    words = tox.words_of(text)
    known = {w: n for n, w in enumerate(dict.fromkeys(words))}
    return tox.Example(lang, toxic, np.array([tox.buckets(w) for w in known], dtype=np.int64).reshape(-1, tox.PARTS), np.array([known[w] for w in words], dtype=np.int64))


def made(seed=3, n=240):
    """Clean and toxic texts of two languages; a toxic word has many endings, none of them twice as likely."""
    rng, rows, labels = random.Random(seed), [], []
    common = {"en": ["the", "stone", "river", "walks", "green", "again"], "xx": ["ka", "lomi", "seta", "uro", "pima", "tolu"]}
    bad = {"en": "grobl", "xx": "zukat"}
    for i in range(n):
        lang, toxic = ("en", "xx")[i % 2], i % 5 < 2
        words = [rng.choice(common[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(3, 60))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), bad[lang] + "".join(rng.choice("aeiou") for _ in range(3)))
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    return rows, labels


def slow_logit(net, text):
    """One text's logit, window by window."""
    words = tox.words_of(text)
    vector = lambda w: sum(net.vectors[b].astype(np.float64) for b in tox.buckets(w))
    total, number = float(net.last[0]), 0
    for width, filters in net.filters.items():
        for f in range(tox.WIDTHS[width]):
            found = sorted((sum(float(vector(words[i + j]) @ filters[j, :, f]) for j in range(width) if i + j < len(words)) for i in range(len(words))), reverse=True)
            total += sum(max(0.0, x + float(net.bias[number])) * float(net.out[number, k]) for k, x in enumerate(found[: tox.TOP]))
            number += 1
    return total


def test_scores_equal_window_by_window(spark):
    rows, labels = made(n=60)
    model = tox.Model([example(t, y, lang) for (_, t, lang), (_, y) in zip(rows, labels)])
    texts = [t for _, t, _ in rows[:12]] + ["", "word", "two words", "the the the the"]
    found = tox.Scorer(model)([tox.words_of(t) for t in texts])
    own = model.languages.of_examples([example(t) for t in texts])
    want = model.scores(np.array([slow_logit(model.net, t) for t in texts]), own)
    assert np.abs(found - want).max() < 1e-4
    assert np.abs(model.net.logits([example(t) for t in texts]) - [slow_logit(model.net, t) for t in texts]).max() < 1e-3
    sums = lambda t: [sum(float(model.languages.logs[tox.buckets(w)[0], k]) for w in tox.words_of(t)) for k in (0, 1)]
    assert [int(k) for k in own] == [int(np.argmax(sums(t))) if t else 2 for t in texts]


def test_gradients_equal_differences():
    rows, labels = made(n=20)
    examples = [example(t, y) for (_, t, _), (_, y) in zip(rows, labels)]
    net = tox.Net(examples, 1)
    weight = np.array([1.0, 2.0])
    params = [net.vectors, *net.filters.values(), net.bias, net.out, net.last]
    for p in params:
        p[...] = p  # float32 in place
    grads = net._gradients(examples, weight)

    def loss():
        z, y = net.logits(examples), np.array([e.toxic for e in examples])
        return float(np.mean(weight[y] * (np.logaddexp(0, z) - y * z)))

    rng = np.random.default_rng(0)
    for p, g in zip(params, grads):
        places = np.argwhere(np.abs(g) > 1e-4)
        for at in map(tuple, places[rng.permutation(len(places))[:6]]):
            kept, step = p[at], 1e-2
            p[at] = kept + step
            up = loss()
            p[at] = kept - step
            down = loss()
            p[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_thresholds_are_calibrated_by_language():
    z, y, w = np.array([3.0, 2.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 0, 0]), np.ones(5)
    assert tox.best_threshold(z, y, w) == 1.5
    assert tox.best_threshold(np.array([1.0, 1.0, 0.0]), np.array([1, 0, 0]), np.ones(3)) == 0.5  # ties stay together
    assert tox.best_threshold(np.array([1.0, 1.0]), np.array([1, 1]), np.ones(2)) == 0.0
    rows, labels = made(n=200)
    model = tox.Model([example(t, y, lang) for (_, t, lang), (_, y) in zip(rows, labels)])
    assert model.languages.names == ["en", "xx"] and len(set(model.thresholds.tolist())) > 1
    assert np.allclose(model.scores(model.thresholds, np.arange(3)), tox.AT_THRESHOLD)


def test_unseen_endings_and_held_out_rows(spark):
    rows, labels = made()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in tox.score(docs, tox.fit(docs, marks)).collect()}
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in found.items())
    tested = [(found[d].predicted, y) for d, y in labels if held_out(d)]
    assert sum(p == y for p, y in tested) >= 0.9 * len(tested) and len(tested) > 50
    # Held-out labels and the column lang change nothing.
    other = marks.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    model = tox.fit(docs, other)
    again = {r.doc_id: r.score for r in tox.score(docs.selectExpr("doc_id", "text", "'zz' AS lang"), model).collect()}
    assert all(abs(again[d] - r.score) < 1e-6 for d, r in found.items())


def test_held_out_rows_of_the_test_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in tox.op11(spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 0]
    assert len(toxic) > 100 and sum(p for _, p, _ in toxic) >= 0.9 * len(toxic)
    assert sum(p for _, p, _ in clean) <= 0.01 * len(clean)


def test_odd_rows(spark):
    rows, labels = made(n=60)
    odd = [(None, rows[0][1], "en"), (900, None, None), (901, "", "en"), (902, " \n ", "xx"), (903, rows[1][1], "en"), (903, rows[1][1], "en"), (904, "x " * 200_000, "en"), (905, "!!! 12", None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("toxic", tox.F.lit("clash"))
    marks = spark.createDataFrame(labels + [(0, None), (None, 1), (1, 1), (903, 0), (999, 1)], "doc_id long, toxic int").withColumn("text", tox.F.lit(1))
    assert {r.doc_id: r.toxic for r in tox.labelled(marks).collect()}[1 if not held_out(1) else 903] in (0, 1)
    model = tox.fit(docs, marks)
    found = tox.score(docs, model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(odd) and not by[None].held_out and by[None].score == pytest.approx(by[0].score, abs=1e-6)
    assert by[900].score == by[901].score == by[902].score
    assert tox.score(docs.where("false"), model).count() == 0
    for none in (marks.where("false"), marks.where("toxic = 1")):
        unfitted = tox.score(docs, tox.fit(docs, none)).collect()
        assert len(unfitted) == len(found) and all(r.score == 0 and r.predicted == 0 for r in unfitted)


def test_samples_are_bounded(spark):
    rows, labels = made(n=90)
    docs = spark.createDataFrame(rows + [(3, f"copy {i}", "en") for i in range(40)], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r.toxic: r["count"] for r in tox.sampled(docs, marks, per_class=5).groupBy("toxic").count().collect()} == {0: 5, 1: 5}
    assert tox.sampled(docs, marks, per_class=20, most=4).count() == 2  # at least one of each class


def test_rows_beyond_the_sample_of_a_trial_are_learned(spark):
    """Of 1,700 toxic rows to learn from, the 60 with the greatest hashes alone hold a word; no sample of
    the 1,500 least hashes shows it."""
    common = ["the", "stone", "river", "walks", "green", "again"]
    rng = random.Random(5)
    ids = [d for d in range(5_100) if not held_out(d)]
    toxic = [d for d in ids if d % 2]
    hashed = spark.createDataFrame([(d,) for d in toxic], "doc_id long").select("doc_id", tox.F.xxhash64("doc_id", tox.F.lit(11)).alias("h"))
    last = {r.doc_id for r in hashed.orderBy("h").collect()[-60:]}
    assert len(toxic) - 60 > 1_500
    words = lambda d: [rng.choice(common) for _ in range(6)] + (["zukat", "zukat"] if d in last else ["grobl", "grobl"] if d % 2 else ["leaf"])
    rows = [(d, " ".join(words(d)), "en") for d in ids]
    tested = [d for d in range(10_000, 10_400) if held_out(d)]
    new = [(d, " ".join([rng.choice(common) for _ in range(6)] + (["zukat", "zukat"] if d % 2 else ["leaf"])), "en") for d in tested]
    model = tox.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, toxic int"))
    found = {r.doc_id: r.predicted for r in tox.score(spark.createDataFrame(new, SCHEMA), model).collect()}
    assert len(tested) > 50 and all(found[d] == d % 2 for d in tested)


def test_counts_rounds_and_thresholds_are_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tox, "SHARD", 12)
    rows, labels = made(n=90)
    copies = [(4, rows[4][1], "en")] * 3 + [(6, "another text", None)]
    docs, marks = spark.createDataFrame(rows + copies, SCHEMA).repartition(7), spark.createDataFrame(labels, "doc_id long, toxic int")
    table = tox.examples_of(docs, marks)
    held = table.orderBy("shard").collect()
    y = dict(labels)
    want = sorted((y[d], tox.words_of(t), lang or "") for d, t, lang in rows + copies if not held_out(d))
    assert len(held) == len(want) and len({r.shard for r in held}) > 2
    examples = [tox._example(r.lang, r.toxic, r.parts, r.at, r.fold) for r in held]
    shown = lambda e: (e.toxic, [tuple(p) for p in e.parts[e.at]], e.lang or "")
    assert sorted(map(shown, examples)) == sorted((c, [tuple(tox.buckets(w)) for w in words], lang) for c, words, lang in want)

    having, words = tox.counts_of(table)
    for fold in range(tox.FOLDS):
        assert (having[fold] == tox.having_of([e for e in examples if e.fold == fold])).all()
    local = tox.words_by_language(examples, {})
    assert words.keys() == local.keys() and all((words[k] == local[k]).all() for k in local)

    whole = having.sum(axis=0)
    nets = [tox.Net([], 20 + k, whole - having[k] if k < tox.FOLDS else whole) for k in range(tox.FOLDS + 1)]
    by_hand = tox.deepcopy(nets)
    tox.train_round(table, nets, 0)
    for k, net in enumerate(by_hand):
        total = 0
        for piece in tox.pieces(iter(table.orderBy("shard").toArrow().to_batches())):
            own = tox._seen(piece, k)
            moved = tox.deepcopy(net)
            if own:
                moved.epoch(own, np.random.default_rng([k, 0]))
                total = total + moved.sums(own)
        net.average(total)
        assert total[net.vectors.size] == sum(e.fold != k for e in examples)
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(net._params(), nets[k]._params()))

    languages = tox.Languages(words)
    found = tox.blind_counts(table, nets, languages)
    assert found[:, 3].sum() == len(examples)
    logits = np.array([nets[e.fold].logits([e])[0] for e in examples])
    toxic, ones = np.array([e.toxic for e in examples]), np.ones(len(examples))
    exact = tox.calibrated(logits, toxic, languages.of_examples(examples), len(languages.names), ones, ones)
    counted = tox.calibrated(found[:, 2] / tox.GRID, found[:, 1], found[:, 0], len(languages.names), found[:, 3], found[:, 3])
    assert np.abs(exact - counted).max() <= 2 / tox.GRID


def test_words_and_hashes_equal_one_by_one():
    import re

    import xxhash

    rng = random.Random(4)
    letters = "abcdefghij0123456789" * 5 + "éß²日"
    words = ["a", "abc", "straße", "x" * 14, "x" * 15, "y" * 300] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 18))) for _ in range(2_000)]
    for word, found in zip(words, tox.buckets_of(words).tolist()):
        parts = ["=" + word, *("^" + word[:k] for k in tox.BEGINNINGS if k <= len(word))]
        want = [xxhash.xxh32_intdigest(p) % (tox.BUCKETS - 1) + 1 for p in parts]
        assert found == want + [0] * (tox.PARTS - len(want))
    for text in ["Hällo, wörld_x ² ½ª\xa0ab\x85c", "ẞ İstanbul Straße", "日本 a-b", "\x1ca\x1db"] + ["".join(chr(rng.randrange(300)) for _ in range(40)) for _ in range(500)]:
        assert tox.words_of(text) == re.findall(r"[^\W_]+", text.lower())


def test_few_texts_without_label_are_shuffled(spark):
    """Of 3,000 texts 300 have a label; the others do not meet the join, and no labelled one is lost."""
    docs = spark.range(3_000).selectExpr("id AS doc_id", "'en' AS lang", "CONCAT('text ', id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'en' AS lang, 'x' AS text"))
    known = spark.range(0, 3_000, 10).selectExpr("id AS doc_id", "0 AS toxic")
    found = [r.doc_id for r in tox.near_labelled(docs, known).collect()]
    assert len(found) == len(set(found)) and set(range(0, 3_000, 10)) <= set(found) and len(found) < 320


def test_training_by_columns_equals_windows():
    rng = np.random.default_rng(2)
    net = tox.Net([example("stone river walks " * 5, 0), example("grobla zukat", 1)], 3)
    x, at = rng.normal(size=(40, tox.DIM)).astype(np.float32), rng.integers(0, 40, 500)
    a, b = tox.convolved(net._projected(x), at), tox.convolved_by_column(net._projection().T @ x.T, at)
    assert a.shape == b.shape and np.allclose(a, b, atol=1e-5)
    places, rows = np.array([3, 70_000, 3, 1]), rng.normal(size=(4, 2)).astype(np.float32)
    for size in (70_001, 1 << 20):
        assert np.allclose(tox.added_up(places, rows, size)[[1, 3, 70_000]], [rows[3], rows[0] + rows[2], rows[1]])
