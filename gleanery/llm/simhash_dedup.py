"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints of 64 bits link when at most ``max_bits`` of them differ. The plan:

1. one Arrow pass makes the fingerprints; equal ones collapse (with map-side combine) to one
   *node*, named by its smallest document id, so a group of copies of any size is one row;
2. bits are dealt into ``max_bits + 2`` blocks. Two linked fingerprints agree on at least two whole
   blocks, so each node is routed once per pair of blocks, to the bucket of those bits (15 pairs of
   about 21 bits for four differing bits). That is exact and grows linearly;
3. within a bucket of any size, rows arrive sorted by Gray rank (range partitioning splits a large bucket
   over many tasks) and are cut into blocks. Neighbours in Gray order share most bits, so each run of
   rows is summed up in an index node: the mask of bits all of them share and their pattern.
   A pair of nodes is pruned as a whole when their patterns already differ in more than
   ``max_bits`` shared bits; what is left is refined level by level down to single fingerprints. Every
   link comes through this index;
4. only a spanning forest of a block's links leaves the task, never all pairs. Blocks of one bucket
   that ended up in different tasks meet pairwise as packed blocks, pruned by the same node test; a bucket of
   more than ``HOT_BLOCKS`` blocks is routed again by parts of its free bits, on one of which linked rows agree;
5. components come from alternating large-star/small-star rounds on the links, each written to the
   shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, lean, materialize

SEED = 42
BITS = 64
#: Rows of one packed index block, fan-out of an index node, packed blocks of a bucket that meet pairwise, and
#: how often larger buckets are routed again (each time by a fifth of their free bits).
BLOCK_ROWS, FANOUT, HOT_BLOCKS, FINER_TIMES = 4096, 16, 8, 2


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Unsigned SimHash of the lower-cased (A-Z) word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        count = 1
    else:
        count = len(words) - shingle_words + 1
        shingles = map(b" ".join, zip(*(words[i : i + count] for i in range(shingle_words)), strict=True))
    return sign_bits(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count))


def sign_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row; a null text has fingerprint 0."""
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(lean(lambda b: _fingerprints(b, shingle_words)), "doc_id bigint, fp bigint")


def _block_masks(max_bits: int) -> list[int]:
    """Signed masks of every pair of the ``max_bits + 2`` bit blocks."""
    blocks = np.array_split(np.arange(BITS), max_bits + 2)
    masks = [sum(1 << int(b) for b in np.concatenate(pair)) for pair in combinations(blocks, 2)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _gray_rank(fp):
    """Position of ``fp`` in the reflected Gray sequence, as a long that sorts in that order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


# --- the index -------------------------------------------------------------------------------


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    """Positions in the reflected Gray sequence."""
    rank = fps
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def index_levels(fps: np.ndarray, starts=(0,)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index levels over Gray-ordered buckets, from single fingerprints up to one root a bucket.

    Each node has the pattern and the mask of the bits that all below it share, and the borders of its children.
    ``starts`` are the first rows of the buckets; no node spans two of them.
    """
    pattern, mask = fps, np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF))
    cuts = np.asarray(starts, np.int64)
    levels = [(pattern, mask, np.arange(len(fps) + 1))]
    while len(pattern) > len(cuts):
        groups = -(-np.diff(np.append(cuts, len(pattern))) // FANOUT)
        first = np.repeat(cuts, groups) + FANOUT * _ragged(groups)
        borders = np.append(first, len(pattern))
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        zeros = np.bitwise_and.reduceat(~pattern & mask, first)
        pattern, mask = ones, ones | zeros
        cuts = np.cumsum(groups) - groups
        levels.append((pattern, mask, borders))
    return levels


def _children(left: np.ndarray, right: np.ndarray, borders_x: np.ndarray, borders_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of each left node with a child of its right node."""
    wide = borders_y[right + 1] - borders_y[right]
    counts = (borders_x[left + 1] - borders_x[left]) * wide
    at, wide = _ragged(counts), np.repeat(wide, counts)
    return np.repeat(borders_x[left], counts) + at // wide, np.repeat(borders_y[right], counts) + at % wide


def index_pairs(x: list, y: list, max_bits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of x and y within ``max_bits``, in bounded portions; of one index (``same``) those within a bucket, once."""
    lift = lambda z: [*z, (*z[-1][:2], np.arange(len(z[-1][0]) + 1))]
    while len(x) < len(y):
        x = lift(x)
    while len(y) < len(x):
        y = lift(y)
    roots = np.arange(len(x[-1][0]))
    stack = [(len(x) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        (pattern_x, mask_x, borders_x), (pattern_y, mask_y, borders_y) = x[level], y[level]
        keep = np.bitwise_count((pattern_x[a] ^ pattern_y[b]) & mask_x[a] & mask_y[b]) <= max_bits
        if same:
            keep &= a <= b if level else a < b
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        for at in range(0, len(a), 1 << 12):
            part = slice(at, at + (1 << 12))
            stack.append((level - 1, *_children(a[part], b[part], borders_x, borders_y)))


class Forest:
    """Smallest member of each linked set of 0..n-1, from arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(jumped := self.root[self.root], self.root):
                self.root = jumped


def _bucket_links(fps: np.ndarray, starts: np.ndarray, max_bits: int) -> np.ndarray:
    """Forest roots of the rows; ``starts`` are the first rows of the buckets, which rows of others never join."""
    forest = Forest(len(fps))
    levels = index_levels(fps, starts)
    for a, b in index_pairs(levels, levels, max_bits, same=True):
        forest.add(a, b)
    return forest.root


_INDEX_SCHEMA = "src bigint, dst bigint, band int, key bigint, block bigint, pattern bigint, mask bigint, fps binary, nodes binary"
_INDEX_FIELDS = [("src", pa.int64()), ("dst", pa.int64()), ("band", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("pattern", pa.int64()), ("mask", pa.int64()), ("fps", pa.binary()), ("nodes", pa.binary())]


def _links_batch(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(src), kind) for _, kind in _INDEX_FIELDS[2:]]
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), *none], schema=pa.schema(_INDEX_FIELDS))


def _block_batch(band: int, key: int, block: int, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    pattern, mask = (int(x[-1].view(np.int64)) for x in index_levels(fps)[-1][:2])
    row = [None, None, band, key, block, pattern, mask, fps.tobytes(), nodes.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(row, _INDEX_FIELDS, strict=True)], schema=pa.schema(_INDEX_FIELDS))


def _index_partition(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within blocks of one sorted partition, and the packed blocks that others must meet.

    A bucket cut by a block or a partition border is emitted as packed blocks as well.
    """
    serial = None
    held = None
    first_key = None
    cut: set[tuple[int, int]] = set()

    def flush(rows, final: bool):
        nonlocal serial, first_key
        band, key, fps, nodes = rows
        change = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], change]).astype(np.int64)
        root = _bucket_links(fps, starts, max_bits)
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield _links_batch(nodes[linked], nodes[root[linked]])
        ends = np.append(starts[1:], len(fps))
        if first_key is None:
            first_key = (int(band[0]), int(key[0]))
        for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
            mine = (int(band[at]), int(key[at]))
            if mine in cut or mine == first_key or (final and end == len(fps)):
                yield _block_batch(*mine, serial, fps[at:end], nodes[at:end])
                serial += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        if serial is None:
            serial = batch.column(4)[0].as_py() << 32
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        rows[2] = rows[2].view(np.uint64)
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        while len(held[0]) > BLOCK_ROWS:
            band, key = held[0], held[1]
            change = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
            change = change[change <= 8 * BLOCK_ROWS]
            if len(change):
                at = int(change[-1])
            else:  # a bucket longer than a block: cut it, and mark it for the packed comparison
                at = BLOCK_ROWS
                cut.add((int(band[0]), int(key[0])))
            yield from flush([x[:at] for x in held], False)
            held = [x[at:] for x in held]
            if len(cut) > 1:
                cut &= {(int(held[0][0]), int(held[1][0]))}
    if held is not None and len(held[0]):
        yield from flush(held, True)


def _block_pairs(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, xn, y, yn in zip(*(batch.column(i) for i in range(4)), strict=True):
            left, right = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            nodes = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in (xn, yn)])
            forest = Forest(len(nodes))
            for a, b in index_pairs(index_levels(left), index_levels(right), max_bits, same=False):
                forest.add(a, b + len(left))
            linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[forest.root[linked]])], ["src", "dst"])


def hamming_links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Spanning links (``src``, ``dst``) of the graph over ``nodes`` (``fp`` distinct, ``node``)."""
    masks = _block_masks(max_bits)
    bands = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    return _links(nodes.select(bands.alias("b"), "fp", "node").select("b.band", "b.key", "fp", "node"), masks, max_bits, FINER_TIMES).distinct()


def _links(routed: DataFrame, masks: list[int], max_bits: int, finer_times: int) -> DataFrame:
    """Links within the buckets of ``routed`` (band, key, fp, node); a band's key is made of the bits of its mask.

    Buckets of many blocks are routed again up to ``finer_times`` times.
    """
    ordered = routed.withColumn("rank", _gray_rank(F.col("fp"))).repartitionByRange("band", "key", "rank").sortWithinPartitions("band", "key", "rank")
    parts = ordered.select("band", "key", "fp", "node", F.spark_partition_id().alias("part"))
    index = materialize(parts.mapInArrow(lean(lambda b: _index_partition(b, max_bits)), _INDEX_SCHEMA), "gray_index", growth=len(masks))
    links = index.where("src is not null").select("src", "dst")
    blocks = index.where("block is not null").drop("src", "dst")
    finer = _finer_masks(masks, max_bits) if finer_times else []
    if finer:
        many = blocks.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BLOCKS).select("band", "key")
        if not many.isEmpty():
            hot = blocks.join(F.broadcast(many), ["band", "key"], "left_semi").select("band", "fps", "nodes")
            rows = hot.mapInArrow(lean(_unpacked), "band int, fp bigint, node bigint")
            each = len(finer) // len(masks)
            deeper = F.explode(F.expr(f"transform(sequence(0, {each - 1}), i -> band * {each} + i)")).alias("band")
            mask = F.element_at(F.array(*map(F.lit, finer)), F.col("band") + 1)
            again = rows.select(deeper, "fp", "node").select("band", F.col("fp").bitwiseAND(mask).alias("key"), "fp", "node")
            links = links.unionByName(_links(again, finer, max_bits, finer_times - 1))
            blocks = blocks.join(F.broadcast(many), ["band", "key"], "left_anti")
    left, right = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in ("band", "key", "block", "pattern", "mask", "fps", "nodes"))) for side in "xy")
    apart = F.bit_count(F.col("pattern_x").bitwiseXOR(F.col("pattern_y")).bitwiseAND(F.col("mask_x")).bitwiseAND(F.col("mask_y")))
    pairs = left.join(right, (F.col("band_x") == F.col("band_y")) & (F.col("key_x") == F.col("key_y")) & (F.col("block_x") < F.col("block_y")) & (apart <= max_bits))
    across = pairs.select("fps_x", "nodes_x", "fps_y", "nodes_y").mapInArrow(lean(lambda b: _block_pairs(b, max_bits)), "src bigint, dst bigint")
    return links.unionByName(across)


def _finer_masks(masks: list[int], max_bits: int) -> list[int]:
    """Each mask with one of ``max_bits + 1`` parts of its free bits, on one of which linked fingerprints agree; none where bits are too few."""
    finer = []
    for mask in masks:
        free = [b for b in range(BITS) if not mask >> b & 1]
        if len(free) <= max_bits:
            return []
        for part in np.array_split(np.array(free), max_bits + 1):
            more = (mask % (1 << BITS)) | sum(1 << int(b) for b in part)
            finer.append(more - (1 << BITS) if more >> (BITS - 1) else more)
    return finer


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for band, fps, nodes in zip(*batch.columns, strict=True):
            fp, node = np.frombuffer(fps.as_py(), np.int64), np.frombuffer(nodes.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), band.as_py(), np.int32)), pa.array(fp), pa.array(node)], ["band", "fp", "node"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node with a link.

    Alternating large-star and small-star rounds; each round's links are a table in the shared folder.
    """

    def larger_first(e):
        return e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()

    def signature(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())

    edges = materialize(larger_first(links), "links")
    seen = signature(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = larger_first(both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
        before, edges = edges, materialize(larger_first(small), "links")
        drop(before)
        now = signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits.
    Texts without words (null, empty, white space) have fingerprint 0 and link like any other. Rows
    with a null id have a fingerprint; their component is that of the rows they link to, and null if no
    row with an id has the same fingerprint. Rows that repeat an id each get a row. An empty table
    gives an empty result; extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    components = connected_components(hamming_links(nodes, max_bits))
    named = materialize(nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "components")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")
