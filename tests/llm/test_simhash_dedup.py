"""Near-duplicate groups against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from gleanery.llm import simhash_dedup as sd


def slow_fingerprint(text, k=4):
    if text is None:
        return 0
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fp); smallest id reachable over links of <= 4 bits, by union-find over all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 4:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def test_fingerprint_matches_plain_definition():
    rng = random.Random(1)
    words = ["Ab", "c", "DÉ", "x|y", "zz", "é"]
    texts = [None, "", " \t\n\r\x0b\x0c", "one", "A b C d", "a b c\x1cd e"] + [rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    assert [sd.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))) for _ in range(40)]
    texts = [None, "", "   "]
    for b in base:
        for _ in range(rng.randint(1, 6)):
            words = b.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = [(i * 3, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int").repartition(5)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in sd.near_duplicates(df).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t, *_ in rows]
    expected = brute_components(prints)
    assert got == {i: (fp, expected[i]) for i, fp in prints}


@pytest.mark.parametrize("block_rows", [16, 64, 4096])
def test_large_tight_bucket_crosses_blocks(spark, monkeypatch, block_rows):
    """Chains of fingerprints a few bits apart, cut into many packed blocks."""
    rng = random.Random(3)
    fps, at = set(), 0x0123456789ABCDEF
    for _ in range(600):
        for _ in range(rng.choice([1, 3, 4, 6])):
            at ^= 1 << rng.randrange(20)
        fps.add(at)
    for _ in range(100):
        fps.add(rng.getrandbits(64))
    rows = list(enumerate(sorted(fps, key=lambda _: rng.random())))
    masks = sd._block_masks(4)
    monkeypatch.setattr(sd, "BLOCK_ROWS", block_rows)

    def partition(part, number):
        import pyarrow as pa

        arrays = [*(pa.array([p[i] for p in part], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))), pa.array([number] * len(part), pa.int32())]
        step = 37
        return [pa.RecordBatch.from_arrays([a.slice(s, step) for a in arrays], list("bkfnp")) for s in range(0, len(part), step)]

    def signed(x):
        return x - 2**64 if x >> 63 else x

    def rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        return x

    routed = sorted((b, signed(fp & (m % 2**64)), rank(fp), signed(fp), n) for n, fp in rows for b, m in enumerate(masks))
    routed = [(b, k, f, n) for b, k, _, f, n in routed]
    cuts = [0, len(routed) // 3 + 5, 2 * len(routed) // 3 + 1, len(routed)]
    links, blocks = [], []
    for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
        for batch in sd._index_partition(iter(partition(routed[s:e], p)), 4):
            for r in batch.to_pylist():
                (links if r["src"] is not None else blocks).append(r | {"part": p})
    for x in blocks:
        for y in blocks:
            if (x["band"], x["key"]) == (y["band"], y["key"]) and x["block"] < y["block"]:
                import pyarrow as pa

                pair = pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (x["fps"], x["nodes"], y["fps"], y["nodes"])], list("abcd"))
                for batch in sd._block_pairs(iter([pair]), 4):
                    links += batch.to_pylist()
    parent = {n: n for n, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = find(r["src"]), find(r["dst"])
        parent[max(a, b)] = min(a, b)
    assert {n: find(n) for n, _ in rows} == brute_components(rows)
    assert len(links) < 15 * len(rows) * 3


def test_hot_buckets_are_routed_again(spark, monkeypatch):
    """With no block allowed to meet another at first, every bucket that borders cut goes through finer masks once."""
    monkeypatch.setattr(sd, "HOT_BLOCKS", 0)
    monkeypatch.setattr(sd, "FINER_TIMES", 1)
    rng = random.Random(8)
    fps, at = set(), 0x0123456789ABCDEF
    for _ in range(250):
        for _ in range(rng.choice([1, 3, 4, 6])):
            at ^= 1 << rng.randrange(24)
        fps.add(at)
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(n, fp - 2**64 if fp >> 63 else fp) for n, fp in rows], "node long, fp long").repartition(4)
    parent = {n: n for n, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in sd.hamming_links(df).collect():
        a, b = find(r.src), find(r.dst)
        parent[max(a, b)] = min(a, b)
    assert {n: find(n) for n, _ in rows} == brute_components(rows)
    masks = sd._block_masks(4)
    assert len(sd._finer_masks(masks, 4)) == 75 and sd._finer_masks([-1], 4) == []


def test_every_link_comes_through_the_index(monkeypatch):
    found = []
    monkeypatch.setattr(sd, "index_pairs", lambda *a, real=sd.index_pairs, **k: (found.append(len(p[0])) or p for p in real(*a, **k)))
    fps = np.array([0, 1, 3, 1 << 40, (1 << 40) | 7, 5 << 50], np.uint64)
    root = sd._bucket_links(fps, np.array([0, 3, 5]), 4)
    assert root.tolist() == [0, 0, 0, 3, 3, 5] and sum(found) == 4


def test_gray_index_prunes_but_loses_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    y = np.concatenate([x[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)), rng.integers(0, 2**63, 77, dtype=np.uint64)])
    found = {(int(i), int(j)) for a, b in sd.index_pairs(sd.index_levels(x), sd.index_levels(y), 4, same=False) for i, j in zip(a, b, strict=True)}
    d = np.bitwise_count(x[:, None] ^ y[None, :])
    assert found == {(int(i), int(j)) for i, j in np.argwhere(d <= 4)}


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert sd.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "lonely words in a null row")]
    got = sorted(((r.doc_id, r.component_id) for r in sd.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
