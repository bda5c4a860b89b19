"""Quality rules: base counts against brute force, and held-out accuracy of the learned list."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from gleanery.llm import quality_rules as q

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*base, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def sample_texts(rng):
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x " * 30000, "é|ü\x0b\x0cß 😀 #$", "l\nl\n l\nl \nl\n\n \n"]
    for _ in range(120):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 10, 200]))] + ["ß", "a|b", " ", "#"]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 150))))
    return texts


def test_base_counts_match_brute_force(spark):
    texts = sample_texts(random.Random(1))
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "a b c", "y", 0), (3, texts[3], "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _q_n_words string, n_words int").repartition(4)
    empty = spark.createDataFrame([], LABELS)
    got = q.judge(docs, empty).collect()
    want = Counter((i, *brute(t)) for i, t, *_ in rows)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert list((found - want).items())[:5] == [] == list((want - found).items())[:5]
    assert all(r.kept == (not r.base_failed) for r in got)
    kept = q.keep_good(docs, empty)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert q.judge(docs.limit(0), empty).count() == 0


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 150))]
        bad = rng.random() < 0.3
        if bad and rng.random() < 0.5:
            words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_learned_list_is_accurate_on_held_out_rows(spark):
    rows, labels = corpus(random.Random(2), 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels[:300], (None, 0, 0), (5, None, None)], LABELS)
    rules = q.learn_from(docs, marks)
    assert 1 <= len(rules) <= q.MAX_RULES
    got = {r.doc_id: r.kept for r in q.judge(docs, marks, rules=rules).collect()}
    held = labels[300:]
    assert sum(got[i] == bool(good) for i, good, _ in held) >= 0.97 * len(held)
    assert "CASE WHEN" in str(q.verdict(rules)) and all(str(t) for r in rules for t in r)


@pytest.mark.parametrize("quality", [0, 1])
def test_labels_of_one_kind(spark, quality):
    rows, _ = corpus(random.Random(3), 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, quality, 0) for i, _ in rows], LABELS)
    assert q.judge(docs, marks).count() == 30


def test_main_path_is_native(spark):
    rows, labels = corpus(random.Random(4), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = q.judge(docs, spark.createDataFrame(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
