"""Near copies against all pairs of exact shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline as cp
import numpy as np
from gleanery.llm import near_copies as nc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(4000)}" for _ in range(n)]


def plain_set(words):
    return {tuple(w.lower() for w in words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """Smallest id over links of similarity 0.8 or more, by all pairs."""
    sets = {i: plain_set(w) for i, w in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3)
    return cp.near_duplicates(spark, docs, "")


def test_a_copy_with_one_changed_word_goes(spark):
    rng = random.Random(1)
    texts = {i: prose(rng, rng.randint(101, 160)) for i in range(40)}
    texts[41] = texts[6][:100] + ["edit"] + texts[6][101:]
    kept = {r.doc_id for r in stage(spark, [(i, " ".join(w)) for i, w in texts.items()]).collect()}
    assert kept == set(range(40))


def test_same_documents_stay_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nc, "SAMPLE", 2)
    rng = random.Random(2)
    line = prose(rng, 40, "line")
    texts = {}
    for _ in range(25):
        base = prose(rng, rng.randint(1, 150)) + (line if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words += prose(rng, rng.randint(1, 30))
            texts[len(texts)] = words
    expected = groups(texts)
    assert 30 < len(set(expected.values())) < len(texts) - 30
    kept = {r.doc_id for r in stage(spark, [(i, " ".join(w)) for i, w in texts.items()]).collect()}
    assert kept == set(expected.values())


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    rng = random.Random(4)
    twice, nameless, one, other = (" ".join(prose(rng, 60)) for _ in range(4))
    rows = [(1, twice), (1, twice), (None, nameless), (None, nameless), (3, one), (3, other), (2, other + " more"), (None, one)]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, rows).collect()), key=str)
    assert got == sorted([(1, twice), (None, nameless), (3, one), (2, other + " more")], key=str)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)]))
        common = a[rng.random(len(a)) < 0.4]
        counts = rng.integers(3, 9, len(common))
        both = len(np.intersect1d(a, b))
        if len(b) and 5 * both >= 4 * (len(a) + len(b) - both):
            shared = set(nc.prefix(a, common, counts)) & set(nc.prefix(b, common, counts))
            assert len(shared) >= 1 + max(len(a), len(b)) // nc.SHARE


def family(rng, members, n, edits):
    base = prose(rng, n)
    texts = []
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(n)] = f"edit{rng.randrange(10**6)}"
        texts.append(words)
    return texts


def test_a_large_family_in_blocks_is_grouped_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nc, "BLOCK_SHINGLES", 3000)
    rng = random.Random(5)
    texts = dict(enumerate(family(rng, 120, 120, 7) + family(rng, 9, 80, 3)))
    expected = groups(texts)
    assert 12 < len(set(expected.values())) < 100
    assert {r.doc_id for r in stage(spark, [(i, " ".join(w)) for i, w in texts.items()]).collect()} == set(expected.values())


def test_the_index_finds_nearly_all_links(monkeypatch):
    """The comparison of what the index leaves apart is for links of unusually many bits only."""
    rng = random.Random(6)
    texts = dict(enumerate(w for _ in range(12) for w in family(rng, 12, 150, 5)))
    sets = [nc.shingle_set(" ".join(w)) for w in texts.values()]
    sketches = np.array([nc.sign_bits(s) for s in sets], np.uint64)
    monkeypatch.setattr(nc, "_rest", lambda *_: None)
    expected = groups(texts)
    got = nc.block_roots(sketches, sets).tolist()
    linked = [i for i in texts if expected[i] != i]
    assert len(linked) > 60
    assert sum(got[i] == expected[i] for i in linked) >= 0.98 * len(linked)


def test_clashing_columns_repeats_and_a_very_long_text(spark):
    rng = random.Random(7)
    long_text, short = " ".join(prose(rng, 200_000)), " ".join(prose(rng, 70))
    rows = [(5, long_text, 1, "a"), (4, long_text + " more", 2, "b"), (3, short, 3, "c"), (3, short, 3, "c"), (2, None, 4, "d"), (1, " ", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, node string")
    kept = nc.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.row) for r in kept.collect()) == [(1, 5), (3, 3), (4, 2)]


def test_empty_table(spark):
    assert stage(spark, []).count() == 0
