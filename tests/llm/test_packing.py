"""Packing: exact round trips of ids, gapless offsets, little padding."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import packing, tokens

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


TRICKY = [
    "", " ", "a", " a b", "a  b", "a \n b\n\nc", "it's we'll  DON'T", "x y z", "a b c d", "tab\t x", "été où 123 4567 $#@ <|im", "word.\nNext line , and; so",
    "a<|endoftext|>b c", "x" * 5000, " " * 3000 + "y", "é1" * 900, "emoji 😀 😀😀 ok", "\x1c \x1d a \x85b c", "漢字 かな 混じり text", " lead", "trail ", "a ​ b", "a ᠎ b c",
]


def test_engine_ids_equal_tokenizers_ids(tokenizer):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "1", "9", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "<|", "ß", "\u00a0", "\u3000", "漢", "\x1f", "\u0301", "\U0001f600", "\x00"]
    texts = TRICKY + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    e = tokens.Encoder(tokens.default_path())
    for t in texts:
        assert e.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, docs, tokenizer, capacity=1024):
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs]
    want = sorted(((d, len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for (d, _), i in zip(docs, ids, strict=True)), key=str)
    assert sorted({(r.doc_id, r.doc_tokens) for r in rows}, key=str) == sorted({(d, n) for d, n, _ in want}, key=str)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_doc = defaultdict(list)
    for (d, _), i in zip(docs, ids, strict=True):
        by_doc[d].append(i)
    for r in rows:
        assert any(zlib.crc32(np.asarray(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i in by_doc[r.doc_id])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def test_pack_documents(spark, tokenizer):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "of", "thtion", "éaux", "x."]) for _ in range(int(rng.lognormvariate(5, 1.2))))) for i in range(300)]
    docs += [(300, None), (301, ""), (5, docs[5][1]), (None, "a b c"), (302, "tok " * 9000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", length int, part string").repartition(4)
    rows = packing.pack_documents(df).collect()
    used = check(rows, docs, tokenizer)
    total = sum(r.length for r in rows)
    assert used <= 1.03 * -(-total // 1024) + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_holds_each_piece_once_and_is_near_the_bound():
    rng = np.random.default_rng(3)
    for sizes in ([1024] * 5, [600] * 11, [1] * 3000, rng.integers(1, 1024, 5000), rng.geometric(1 / 300, 20000).clip(1, 1023), [700, 300, 24] * 50):
        values, counts = np.unique(sizes, return_counts=True)
        plan = packing.plan_patterns(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        held = defaultdict(int)
        for pattern, times in plan:
            assert sum(n * k for n, k in pattern.items()) <= 1024
            for n, k in pattern.items():
                held[n] += k * times
        assert dict(held) == dict(zip(values.tolist(), counts.tolist(), strict=True))
        if len(values) > 100:
            assert sum(t for _, t in plan) <= 1.01 * np.sum(sizes) / 1024 + 2


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 15, 4))
        values = rng.random(len(lengths))
        value, pattern = packing.best_pattern(values, lengths, 30)
        best = 0.0
        grid = [range(30 // int(n) + 1) for n in lengths]
        for combo in np.array(np.meshgrid(*grid)).T.reshape(-1, len(lengths)):
            if combo @ lengths <= 30:
                best = max(best, float(combo @ values))
        assert pattern @ lengths <= 30 and abs(pattern @ values - best) < 1e-9 and abs(value - best) < 1e-9


def test_another_kind_of_tokenizer_file_is_left_to_its_own_library(tmp_path):
    import json

    from gleanery.llm.tokens import Encoder, _plain_byte_level, default_path

    with open(default_path(), encoding="utf-8") as f:
        file = json.load(f)
    assert _plain_byte_level(file)
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    other = Encoder(str(tmp_path / "other.json"))
    assert other.engine is None
    assert other.ids("plain words").tolist() == other.tokenizer.encode("plain words", add_special_tokens=False).ids
