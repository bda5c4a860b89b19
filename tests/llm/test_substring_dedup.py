"""Repeated-passage removal against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from gleanery.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def brute(rows, width):
    split = {i: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for i, (_, t) in enumerate(rows)}
    count = Counter(tuple(w[s : s + width]) for w in split.values() for s in range(len(w) - width + 1))
    out = []
    for i, (doc, _) in enumerate(rows):
        words, gone = split[i], set()
        for s in range(len(words) - width + 1):
            if count[tuple(words[s : s + width])] > 1:
                gone |= set(range(s, s + width))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(rng, n, vocabulary, passages, length):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, length))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("shard_segments", [1, 4, 256])
def test_matches_brute_force(spark, shard_segments):
    rng = random.Random(5)
    passages = [[f"p{k}x{j}" for j in range(rng.randint(8, 40))] for k in range(4)] + [["a"] * 30, ["a", "b"] * 12]
    rows = corpus(rng, 70, 3000, passages, 50)
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (900, ""), (901, None), (902, "\x0b \x0c"), (903, "a " * 400)]
    assert run(spark, rows, min_words=12, anchor_words=(4, 8), shard_segments=shard_segments) == brute(rows, 12)


def test_production_window_and_long_text(spark):
    rng = random.Random(6)
    passage = [f"p{j}" for j in range(60)]
    long = [f"l{rng.randrange(500)}" for _ in range(20000)]
    rows = [(i, " ".join([f"d{i}x{j}" for j in range(30)] + passage + [f"e{i}x{j}" for j in range(10)])) for i in range(12)]
    rows += [(100, " ".join(long)), (101, " ".join(long[5000:5100])), (102, " ".join(passage[:34]))]
    got = run(spark, rows)
    assert got == brute(rows, 35)
    assert {r[0]: r[2] for r in got}[0] == 60


def test_edges(spark):
    assert run(spark, []) == []
    clashing = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, anchor string, k1 int")
    assert [tuple(r) for r in sd.replace_texts(clashing).collect()] == [(1, "a b", "x", 2)]


def test_replaced_texts_are_the_kept_words(spark):
    rng = random.Random(8)
    rows = corpus(rng, 40, 3000, [[f"p{j}" for j in range(30)]], 40) + [(None, None), (77, ""), (None, "k  k")]
    df = spark.createDataFrame([(i, t, "en", f"c{k}") for k, (i, t) in enumerate(rows)], SCHEMA + ", spans string, _k1 string")
    got = sd.replace_texts(df, min_words=12, anchor_words=(4,)).collect()
    expected = {(d, n, sha): gone for d, n, gone, sha in brute(rows, 12)}
    for r in got:
        original = rows[int(r._k1[1:])][1]
        if original is None or r.text == original:
            continue
        sha = hashlib.sha256(r.text.encode()).hexdigest()
        assert expected[(r.doc_id, len(original.split()), sha)] > 0
    assert len(got) == len(rows) and sum(r.text != rows[int(r._k1[1:])][1] for r in got) == sum(g > 0 for g in expected.values())


def test_automaton_counts_every_substring():
    rng = random.Random(7)
    for _ in range(40):
        seqs = [("".join(rng.choices("ab", k=rng.randint(1, 12))), rng.randint(1, 3)) for _ in range(3)]
        automaton = sd.SuffixAutomaton()
        for s, copies in seqs:
            automaton.add(s, copies)
        total = automaton.total()
        for s, _ in seqs:
            for least in (1, 3):
                ends = set(automaton.repeated_ends(s, total, least))
                expected = {e for e in range(least, len(s) + 1) if sum(c * sum(t.startswith(s[e - least : e], k) for k in range(len(t))) for t, c in seqs) > 1}
                assert ends == expected
