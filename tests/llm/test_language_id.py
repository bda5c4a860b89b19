"""Language identification: held-out accuracy, back-off, edges."""

from __future__ import annotations

import random
import zlib

from gleanery.llm import language_id as li

STEMS = {"en": "the and of th in ing tion er", "fr": "le la eau ment tion eux ou é", "de": "der die und sch ung keit ß ü", "es": "el los ción mente ando ñ que ar"}
SCHEMA = "doc_id long, text string, lang string"


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        stems = STEMS[lang].split()
        words = [rng.choice(stems) if rng.random() < 0.4 else "".join(rng.choices(stems, k=rng.randint(2, 4))) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(words).capitalize() + ".", lang if rng.random() < 0.9 else None, lang))
    return rows


def test_held_out_accuracy_and_columns(spark):
    rows = corpus(random.Random(1), 600)
    df = spark.createDataFrame([(*r[:3], "x", 0.5) for r in rows], SCHEMA + ", lang_pred string, score double").repartition(3)
    got = {r.doc_id: r for r in li.identify(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 80
    assert sum(got[r[0]].lang_pred == r[3] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = corpus(random.Random(2), 200)
    one = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    two = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g, _ in rows], SCHEMA)
    a, b = li.learn(one), li.learn(two)
    assert a.languages == b.languages and a.words == b.words and (a.word_scores == b.word_scores).all()


def test_backoff_uses_the_longest_known_order():
    words = [("a", "abc", 5), ("b", "xyz", 5)]
    grams = [(lang, g, n) for lang, w, n in words for size in range(1, 6) for g in li.grams_of(w, size)]
    model = li.LanguageModel.build(words, grams)
    assert model.predict("abc") == model.predict("ABC!") and model.predict("abc")[0] == "a"
    assert model.predict("xyzq")[0] == "b" and model.predict("zzzz")[0] == "b"
    assert model.backoff("qqq") is not None  # the word's borders are known
    known = [model.grams[g] for g in ("<abc",)]
    assert (model.backoff("abcq") == li.GRAM_WEIGHT * model.gram_scores[[*known]].mean(axis=0)).all() or model.backoff("abcq")[0] > model.backoff("abcq")[1]


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 -- ² _", "en"), (None, "the and of", "en"), (5, "the and of", "en"), (5, "the and of", "en"), (8, "die und der", "de"), (9, "word " * 100000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in li.identify(df).collect()]
    assert len(got) == len(rows)
    assert all(g[2:] == ("und", 0.0) for g in got if g[0] in (1, 2, 3))
    assert all(g[2] in ("en", "de") for g in got if g[0] in (None, 5, 8, 9))
    assert li.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in li.identify(df.withColumn("lang", li.F.lit(None).cast("string"))).collect()} == {"und"}


def test_frequent_entries_without_ranking(spark):
    counts = spark.createDataFrame([("en", f"w{i}", n) for i, n in enumerate([9, 5, 5, 2, 2, 2, 1])] + [("fr", "x", 3)], "lang string, word string, n long")
    got = li.frequent(counts, "word", 8)
    assert got == [("en", "w0", 9), ("en", "w1", 5), ("en", "w2", 5), ("fr", "x", 3)]
    assert li.frequent(counts.limit(0), "word", 8) == []
