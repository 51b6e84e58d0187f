import math
import zlib
from collections import Counter

import numpy as np

from tallyforge.llm import grades, language

SCHEMA = "doc_id long, text string, lang string, score double"


def test_held_out_language_accuracy(spark):
    rows = language.op8(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in tested) >= 0.97 * len(tested)


def slow_language(model, text):
    """Family, then votes of the pairs within it, from counts of byte pairs and triples in a dict."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    found = {}
    for i in range(len(data) - 1):
        pair = data[i] * 257 + data[i + 1]
        hashed = [pair] + ([(pair * 65599 + data[i + 2] + 0x51ED270B) % 2**32] if i + 2 < len(data) else [])
        for x in hashed:
            bucket = x * 0x9E3779B1 % 2**32 >> 32 - language.BITS
            found[bucket] = found.get(bucket, 0) + 1
    length = sum(c * c for c in found.values()) ** 0.5
    margins = [sum(float(w[b]) * c for b, c in found.items()) / length for w in model.weights]
    families = sorted({language.family(x) for x in model.langs})
    n, score = (len(families), 1.0) if len(families) > 1 else (0, 1.0)
    chosen = families[0]
    if n:
        chosen = max(range(n), key=lambda k: (margins[k], -k))
        rest = max(m for k, m in enumerate(margins[:n]) if k != chosen)
        score, chosen = 1 / (1 + math.exp(-2 * (margins[chosen] - rest))), families[chosen]
    members = [x for x in model.langs if language.family(x) == chosen]
    ranked = []
    for lang in members:
        own = [m if a == lang else -m for (a, b), m in zip(model.pairs, margins[n:]) if lang in (a, b)]
        ranked.append((sum(m > 0 for m in own), sum(own), lang))
    votes, margin, best = max(ranked)
    return best, score / (1 + math.exp(-4 * margin / (len(members) - 1))) if len(members) > 1 else score


def test_language_predictions_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = language.predict(docs, model).collect()
    assert len(model.families) > 1 and model.pairs and len(rows) == len(texts)
    for r in rows:
        lang, score = slow_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_language_votes_margins_and_ties():
    """Three languages of one family with given weights: votes decide, then margins, then names."""
    model = language.Model([(x, np.array([], dtype="<u2"), np.array([], dtype="<u4")) for x in ("de", "en", "nl")])
    assert model.pairs == [("de", "en"), ("de", "nl"), ("en", "nl")] and model.families == ["germanic"]
    bucket = int(np.argmax(language.counts("a")))
    for margins, best in (((1, 1, 1), "de"), ((-1, 5, 1), "en"), ((2, -1, 1), "de"), ((1, -2, 1), "nl"), ((1, -1, 1), "nl"), ((0, 0, 0), "nl"), ((-1, -1, 1), "en")):
        model.weights = np.zeros((3, 1 << language.BITS), dtype=np.float32)
        model.weights[:, bucket] = margins
        assert model.predict("a")[0] == slow_language(model, "a")[0] == best, margins


def test_language_odd_rows(spark):
    texts = {"en": "the cat and the dog with other things", "de": "der hund und die katze nicht ein schön", "fr": "le chat et les chiens avec une été", "xx": "zzqq qqzz zqzq"}
    rows = [(i * 4 + k, texts[x], x, 1.0) for i in range(12) for k, x in enumerate(texts)]
    odd = [(900, None, "en", 0.0), (901, "", None, 0.0), (902, "12 !?", "de", 0.0), (None, texts["de"], None, 0.0), (903, texts["fr"], "fr", 0.0), (903, texts["fr"], "fr", 0.0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    found = language.predict(docs, language.fit(docs)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(odd) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[None].lang_pred == "de" and not by[None].held_out and by[903].lang_pred == "fr"
    assert all(by[d].lang_pred == x for d, _, x, _ in rows)
    none = docs.where("false")
    assert language.predict(none, language.fit(none)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}


def test_what_is_a_letter(spark):
    docs = spark.createDataFrame([(k * 4, "der hund und die katze", "de", 1.0) for k in range(5)] + [(901 + i, t, None, 1.0) for i, t in enumerate(["²½ Ⅷ ①", "٣ 12", "ª", "日本"])], SCHEMA)
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(docs)).collect()}
    assert [found[901 + i] for i in range(4)] == ["und", "und", "de", "de"]


def test_language_samples_are_bounded_and_do_not_vanish(spark, monkeypatch):
    """One text of each language is enough, a language of a third of all rows included; the
    texts with the least hashes are those that brute force picks."""
    words = {"en": "the cat and the dog", "de": "der hund und die katze", "fr": "le chat et les chiens"}
    rows = [(4 * i + (i % 7), f"{words[x]} {i}", x, 1.0) for i in range(900) for x in words if x == "fr" or i % 50 == 0]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    real = language.Model.__init__
    monkeypatch.setattr(language.Model, "__init__", lambda self, samples: (seen.update(samples=samples), real(self, samples))[1])
    model = language.fit(docs, per_language=1)
    assert model.langs == ["de", "en", "fr"] and len(seen["samples"]) == 3
    learned = language.learned(docs).selectExpr("lang", "text", "xxhash64(doc_id, 8) AS h").collect()
    for lang, at, count in seen["samples"]:
        text = min((r.h, r.text) for r in learned if r.lang == lang)[1]
        dense = language.counts(text)
        assert dense.sum() == count.sum() and (dense[at] == count).all()
    one_id = spark.createDataFrame([(4, f"{words['fr']} {i}", "fr", 1.0) for i in range(50)], SCHEMA)
    language.fit(one_id, per_language=3)
    assert len(seen["samples"]) == 3


def test_language_long_text_and_ties(spark):
    docs = spark.createDataFrame([(4 * k, t, x, 1.0) for k in range(9) for t, x in (("aa bb", "de"), ("aa bb", "en"))] + [(7, "aa bb " * 300_000, None, 1.0)], SCHEMA)
    found = {(r.doc_id, r.lang_pred) for r in language.predict(docs, language.fit(docs)).collect()}
    assert len({lang for _, lang in found}) == 1  # the same text under both names: one answer for all rows


def slow_features(text):
    """One text's features as a dict, by plain counting."""
    words = (text or "").split()
    if not words:
        return {0: 1.0}
    hasher, n = grades.Hasher(), len(words)
    counts = Counter(hasher.bucket(w) for w in words)
    lines = text.split("\n")
    found = {k: min(1 + math.log(c), 3) / math.sqrt(math.log(n + 1) * 8) for k, c in counts.items()}
    shapes = [1, min(1, sum(c in "#*$%&|<>" for c in text) / n), float(sum(w.isupper() for w in words) > n / 2), 1 - len(counts) / n,
              max(counts.values()) / n, 1 - len(set(lines)) / len(lines), min(1, sum(map(len, words)) / n / 20), min(1, 20 / n)]
    return found | dict(enumerate(shapes))


def test_grades_equal_brute_force(spark, data):
    """Features, scores and tails of every row, text by text; the sample by sorting all labels."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rated = {r.doc_id: r.grade for r in grades.graded(labels).collect() if r.doc_id in texts}
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in rated], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 1) AS h").collect()}
    rows = grades.sampled(docs, labels, per_grade=20).collect()
    want = {g: sorted((hashes[d], d) for d in rated if rated[d] == g)[:20] for g in range(3)}
    for g in range(3):
        mine = sorted((r.h, dict(zip(np.frombuffer(r.at, "<u4").tolist(), np.frombuffer(r.value, "<f4").tolist()))) for r in rows if r.grade == g)
        assert [h for h, _ in mine] == [h for h, _ in want[g]]
        for (_, made), (_, d) in zip(mine, want[g]):
            slow = slow_features(texts[d])
            assert made.keys() == slow.keys() and all(abs(made[k] - slow[k]) < 1e-5 for k in slow)
    model = grades.fit(docs, labels)
    for r in grades.grade(docs, model).collect():
        score = sum(float(model.weights[k]) * v for k, v in slow_features(texts[r.doc_id]).items())
        tails = [1 / (1 + math.exp(-max(-500, min(500, score - c)))) for c in model.cuts]
        assert abs(r.p_above_0 - tails[0]) < 1e-6 and abs(r.p_above_1 - tails[1]) < 1e-6 and abs(r.expected_grade - sum(tails)) < 1e-6


def test_grade_samples_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"copy number {i}") for i in range(40)] + [(d, f"other words {d}") for d in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(60)], "doc_id long, quality int, toxic int")
    assert {(r.grade, r["count"]) for r in grades.sampled(docs, labels, per_grade=5).groupBy("grade").count().collect()} == {(0, 5), (2, 5)}
    assert {r.grade for r in grades.sampled(docs, labels, per_grade=1).collect()} == {0, 2}
    assert grades.sampled(docs, labels, per_grade=20, most=3).count() == 2  # at least one row of a grade


def test_held_out_grades(spark):
    """Fitted on two thirds of the labels, the grades hold on the last third."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = grades.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert model.cuts[0] < model.cuts[1]
    rated = {r.doc_id: r.grade for r in grades.graded(labels.where("doc_id % 3 = 0")).collect()}
    rows = [r for r in grades.grade(docs.where("doc_id % 3 = 0"), model).collect() if r.doc_id in rated]
    good = [r for r in rows if rated[r.doc_id] == 2]
    poor, toxic = ([r for r in rows if rated[r.doc_id] == g] for g in (0, 1))
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in poor) >= 0.95 * len(poor)
    # About a third of the toxic documents hold no word that the sample shows as such.
    assert sum(not r.kept for r in toxic) >= 0.7 * len(toxic)
    words = {r.doc_id for r in docs.where(" OR ".join(f"lower(text) LIKE '%{w}%'" for w in ("idiot", "moron", "scum", "pathetic", "worthless"))).collect()}
    named = [r for r in toxic if r.doc_id in words]
    assert len(named) > 40 and sum(not r.kept for r in named) >= 0.9 * len(named)
    mean = lambda g: sum(r.expected_grade for r in rows if rated[r.doc_id] == g) / sum(1 for r in rows if rated[r.doc_id] == g)
    assert mean(0) < mean(1) < mean(2)
    assert all(r.p_above_0 >= r.p_above_1 for r in rows)


def test_grades_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a word", 1), (3, "fine words here", 1), (3, "fine words here", 1), (4, "### $$$", 1), (5, "w " * 50_000, 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, None), (1, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in grades.graded(labels).collect()} == {3: 2, 4: 0, 5: 1}
    assert grades.grade(docs, grades.fit(docs, labels)).count() == 7
    none = labels.where("false")
    unfitted = grades.grade(docs, grades.fit(docs, none)).collect()
    assert len(unfitted) == 7 and not any(r.kept for r in unfitted) and unfitted[0].expected_grade is None
    assert grades.grade(docs.where("false"), grades.fit(docs, none)).count() == 0
