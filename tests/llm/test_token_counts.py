"""Edit-aware counts equal those of re-encoding the whole text."""

from __future__ import annotations

import random

from gleanery.llm import token_counts as tc
from gleanery.llm.tokens import default_path, encoder


def apply(text, edits):
    for start, end, new in edits:
        start = min(max(start or 0, 0), len(text))
        end = min(max(start if end is None else end, start), len(text))
        text = text[:start] + (new or "") + text[end:]
    return text


def random_text(rng, n):
    return "".join(rng.choice(["word", "éte", "a", "  ", "\n", ".", "12", "'s", "<|endoftext|>", "x y"]) + rng.choice([" ", " ", ""]) for _ in range(n))


def test_tree_equals_whole_text():
    rng, tokenizer = random.Random(1), encoder(default_path())
    for _ in range(150):
        text = random_text(rng, rng.randint(0, 150))
        tree = tc.TokenTree(text, tokenizer, leaf_chars=rng.choice([4, 32, 512]))
        assert tree.text == text and tree.count == tokenizer.count(text)
        for _ in range(12):
            start = rng.randint(-2, len(text) + 2)
            edit = (start, start + rng.choice([0, 0, 1, 5, 200]), rng.choice(["", " ", "new", " two words ", "\n\n", "'s", "<|endof"]))
            text = apply(text, [edit])
            tree.edit(*edit)
            assert tree.text == text and tree.count == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids.__len__()


def test_only_touched_leaves_are_encoded_again():
    tokenizer = encoder(default_path())
    tree = tc.TokenTree("some plain words " * 20000, tokenizer)
    tree.edit(170000, 170004, "other")
    assert tree.encoded_chars < 4 * tc.LEAF_CHARS
    assert tree.count == tokenizer.count(tree.text)


def test_grown_leaves_are_cut_anew():
    rng, tokenizer = random.Random(3), encoder(default_path())
    tree, text = tc.TokenTree("a b", tokenizer, leaf_chars=16), "a b"
    for _ in range(60):
        start = rng.randint(0, len(text))
        new = random_text(rng, rng.choice([1, 40]))
        text = text[:start] + new + text[start:]
        tree.edit(start, start, new)
        assert tree.text == text and tree.count == tokenizer.count(text)
    assert max(map(len, tree.texts)) <= tc.GROWTH * 16 + 200
    tree.encoded_chars = 0
    tree.edit(len(text) // 2, len(text) // 2, "x")
    assert tree.encoded_chars < len(text) // 4


def test_a_long_text_without_spaces():
    tokenizer = encoder(default_path())
    tree = tc.TokenTree("abc" * 5000, tokenizer)
    tree.edit(7000, 7003, "xyz")
    text = ("abc" * 5000)[:7000] + "xyz" + ("abc" * 5000)[7003:]
    assert tree.text == text and tree.count == tokenizer.count(text)


def test_repeated_ids_each_get_the_edits(spark):
    tokenizer = encoder(default_path())
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "other text"), (None, "null id"), (None, "null id"), (2, None)], "doc_id long, text string").repartition(3)
    log = spark.createDataFrame([(1, 0, 0, 3, "new words"), (2, 0, 5, 9, "z"), (None, 0, 0, 0, "x"), (9, 0, 0, 0, "y")], "doc_id long, seq long, start long, end long, replacement string")
    got = sorted(((r.doc_id, r.n_edits, r.edited_tokens) for r in tc.counts_after(docs, log).collect()), key=str)
    one, two = tokenizer.count("new words two three"), tokenizer.count("new wordser text")
    assert got == sorted([(1, 1, one), (1, 1, one), (1, 1, two), (None, 0, tokenizer.count("null id")), (None, 0, tokenizer.count("null id")), (2, 1, 1)], key=str)


def test_tables(spark):
    rng, tokenizer = random.Random(2), encoder(default_path())
    docs = [(i, random_text(rng, rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, ""), (42, "long word " * 30000)]
    edits = [(rng.randint(0, 45), k, rng.randint(0, 300), None if rng.random() < 0.1 else rng.randint(0, 320), rng.choice([None, "", "zz ", " q"])) for k in range(300)]
    expected = {}
    for doc, text in docs:
        mine = [e[2:] for e in sorted((e for e in edits if e[0] == doc), key=lambda e: e[1])]
        expected[doc] = (tokenizer.count(text or ""), len(mine), tokenizer.count(apply(text or "", mine)))
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n_tokens int, d string").repartition(3)
    log = spark.createDataFrame(edits, "doc_id long, seq long, start long, end long, replacement string").repartition(3)
    got = {r.doc_id: tuple(r)[1:4] for r in tc.counts_after(df, log).collect()}
    assert got == expected
    rows = [(d, t, [e[2:] for e in sorted((e for e in edits if e[0] == d), key=lambda e: e[1])] or None) for d, t in docs] + [(None, "a b", None)] * 2
    inline = spark.createDataFrame(rows, "doc_id long, text string, changes array<struct<start: long, end: long, replacement: string>>")
    result = tc.counts_with(inline, "changes").collect()
    assert len(result) == len(rows) and {r.doc_id: tuple(r)[1:4] for r in result if r.doc_id is not None} == expected
    assert tc.counts_after(df.limit(0), log).count() == 0 and tc.counts_with(inline.limit(0), "changes").count() == 0
