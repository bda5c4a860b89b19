"""Decontamination against brute-force word edit distance of every passage."""

from __future__ import annotations

import random

import numpy as np

from gleanery.llm import decontamination as dc


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"ins{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def make(rng, n_docs=250):
    items = [[f"i{rng.randrange(300)}" for _ in range(rng.randint(8, 60))] for _ in range(25)]
    docs = []
    for _ in range(n_docs):
        words = [f"i{rng.randrange(300)}" if rng.random() < 0.3 else f"d{rng.randrange(3000)}" for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.7:
            item = rng.choice(items)
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, int(len(item) * 0.3)))
        docs.append(words)
    return items, docs


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(11)
    items, docs = make(rng)
    items_df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs_df = spark.createDataFrame([(i, " ".join(w).capitalize() + "!", i) for i, w in enumerate(docs)], "doc_id long, text string, item_id long").repartition(3)
    expected = {(d, i): dist for d, w in enumerate(docs) for i, item in enumerate(items) if (dist := brute_distance(item, w)) <= int(0.2 * len(item) + 1e-9)}
    got = {(r.doc_id, r.item_id): r.edit_distance for r in dc.contaminations(docs_df, items_df).collect()}
    assert set(got) <= set(expected)
    assert all(got[k] == expected[k] for k in got)
    assert len(got) >= 0.97 * len(expected) > 80
    exact = {k for k, dist in expected.items() if dist <= 1}
    assert exact <= set(got)
    kept = {r.doc_id for r in dc.drop_contaminated(docs_df, items_df).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}


def test_edit_passage():
    rng = random.Random(12)
    for _ in range(300):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(1, 8))])
        region = np.array([rng.randrange(4) for _ in range(rng.randint(0, 12))], dtype=item.dtype)
        distance, start, end = dc.edit_passage(item, region)
        assert distance == brute_distance(item.tolist(), region.tolist())
        passage = region[start:end].tolist()
        table = list(range(len(passage) + 1))
        for i, a in enumerate(item.tolist(), 1):
            new = [i]
            for j, b in enumerate(passage, 1):
                new.append(min(table[j] + 1, new[-1] + 1, table[j - 1] + (a != b)))
            table = new
        assert table[-1] == distance


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six"), (3, "One, two; three\nfour FIVE six"), (3, "One, two; three\nfour FIVE six"), (4, "x " * 50000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "zz yy xx ww vv uu"), (5, "one two three four five six")], "item_id long, text string")
    got = sorted(tuple(r) for r in dc.contaminations(docs, items).where("doc_id is not null").collect())
    assert got == [(3, 5, 0, 0, 6)] * 2
    assert dc.contaminations(docs, items.limit(0)).count() == 0
    assert dc.contaminations(docs.limit(0), items).count() == 0
    assert dc.drop_contaminated(docs, items).count() == 3


def test_short_items_and_scripts_without_spaces(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(30))
    texts = [(1, "before Four, little words here after four little words here"), (2, "four little other words here"), (3, "甲乙" + han[:10] + "丙" + han[11:] + "丁"), (4, "xFour y"), (5, "go " * 20000 + "four"), (6, "甲乙丙丁")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "four little words here"), (2, "go"), (3, han), (4, "?!")], "item_id long, text string")
    got = sorted(tuple(r) for r in dc.contaminations(docs, items).collect())
    assert got == [(1, 1, 0, 1, 5), (3, 3, 1, 2, 32), (5, 2, 0, 0, 1)]
    assert {r.doc_id for r in dc.drop_contaminated(docs, items).collect()} == {2, 4, 6}


def test_ranges():
    rng = np.random.default_rng(1)
    for _ in range(50):
        low = rng.integers(0, 60, rng.integers(1, 12))
        ranges = np.stack([low, low + rng.integers(0, 6, len(low))], axis=1)
        united = dc._united(ranges)
        assert dc._within(united).tolist() == sorted({x for a, b in ranges.tolist() for x in range(a, b + 1)})
        assert (united[1:, 0] > united[:-1, 1] + 1).all()


def test_a_phrase_that_many_items_share_costs_its_places():
    rng = random.Random(4)
    phrase = [f"p{i}" for i in range(12)]
    items = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(20)] + phrase + [f"b{rng.randrange(10**6)}" for _ in range(20)])) for i in range(500)]
    words = [w for _ in range(200) for w in [*phrase, *(f"x{rng.randrange(999)}" for _ in range(9))]]
    index = dc.ItemIndex.build(items, 0.2)
    starts, _ = index.windows(dc.word_hashes(dc.normal_words(" ".join(words))))
    assert 0 < len(starts) <= len(words)
