"""Operator 6 at a similarity: near copies of five-word similarity 0.8 or more, and their groups.

A text is its set of ``SHINGLE_WORDS``-word shingles (64-bit hashes of words with A-Z lower-cased; a shorter text is one
shingle). Two sets of that similarity differ in some 10 of the 64 SimHash bits, 18 at the most likely worst, which no
choice of bit blocks can route; so shared rare shingles bring fingerprints together, and the Gray-order index finds
the pairs there. The plan is exact, not sampled:

1. equal sets collapse to one *node*, named by a hash of the set;
2. under one order of all shingles, two such sets share at least ``1 + n // 25`` of the first ``n // 5 + 1 + n // 20``
   of each. Any order is right; shingles that a sample of the texts shows to be common come last, the commonest at the
   end. Nodes that share fewer than that with all others together are alone and leave;
3. a shared shingle sends its nodes to the smallest of them, its *pivot*; a node that meets a pivot in too few of its
   shingles stays away (the shared ones of a linked pair are dealt over so many pivots that one holds enough);
4. a pivot's bucket is cut into blocks of bounded size that meet pairwise. In a task, the block's fingerprints are
   sorted by Gray rank under the hierarchical index of ``simhash_dedup``; pairs within ``SKETCH_BITS`` that are still
   apart are compared as whole sets. What is apart then is compared whatever its bits, so no link is lost;
5. only a spanning forest of a block's links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import gram_hashes, word_hashes
from .scratch import drop, fresh_name, lean, materialize
from .simhash_dedup import Forest, connected_components, gray_ranks, index_levels, index_pairs, sign_bits

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
LEAST, OF = 4, 5
#: Prefixes hold one in so many shingles more than needed, so that linked sets share one in ``SHARE`` at least.
LONGER, SHARE = 20, 25
#: One text in so many shows which shingles are common: those in so many sampled texts, up to a number of them.
SAMPLE, COMMON, MOST_COMMON = 8, 3, 500_000
#: Texts that a worker holds as sets at a time, and shingles of a block.
BATCH_ROWS, BLOCK_SHINGLES = 512, 1 << 17
#: Bits of 64 in which the index lets two fingerprints differ.
SKETCH_BITS = 18


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles, sorted; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(gram_hashes(word_hashes(words), min(SHINGLE_WORDS, len(words)))) if words else np.empty(0, np.uint64)


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set of the least similarity has enough among its own first ones.

    Shingles of ``common`` (sorted) come after all others, by their ``counts``.
    """
    n = len(shingles)
    rank = np.zeros(n, np.int64)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")][: n + (-LEAST * n) // OF + 1 + n // LONGER] if n else shingles


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], ["shingle"])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample shows to be common, sorted, and their counts. They order the shingles and decide no link."""
    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(lean(_sampled), "shingle bigint").groupBy("shingle").count().where(F.col("count") >= COMMON)
    most = found.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    shingles, counts = (most.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], counts[order]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _prints(texts: DataFrame) -> DataFrame:
    """``row``, ``node``, ``n`` (shingles) and ``keys`` (the prefix) of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts))

    def scan(batches):
        for batch in _small(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array([prefix(s, *shared.value).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(list(map(len, sets)), pa.int32()), keys], ["row", "node", "n", "keys"])

    return materialize(texts.select("row", "text").mapInArrow(lean(scan), "row bigint, node bigint, n int, keys array<bigint>"), "shingle_prefixes")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        sketches = np.fromiter(map(sign_bits, sets), np.uint64, len(sets)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "sketch", "held"])


def _alike(both, a, b):
    return OF * both >= LEAST * (a + b - both)


def block_roots(sketches: np.ndarray, sets: list[np.ndarray], max_bits: int = SKETCH_BITS) -> np.ndarray:
    """A member of each one's group, for the sets of a block: pairs of the index first, then what is still apart."""
    forest, n = Forest(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(gray_ranks(sketches))
    levels = index_levels(sketches[order])
    for left, right in index_pairs(levels, levels, max_bits, same=True):
        left, right = order[left], order[right]
        nearest = np.argsort(np.bitwise_count(sketches[left] ^ sketches[right]), kind="stable")
        left, right = left[nearest], right[nearest]
        fits = OF * np.minimum(n[left], n[right]) >= LEAST * np.maximum(n[left], n[right])
        left, right = left[fits], right[fits]
        while len(left):
            a, b = int(left[0]), int(right[0])
            if _alike(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), n[a], n[b]):
                forest.add(left[:1], right[:1])
                left, right = left[1:], right[1:]
                apart = forest.root[left] != forest.root[right]
                left, right = left[apart], right[apart]
            else:
                left, right = left[1:], right[1:]
    _rest(forest, sets, n)
    return forest.root


def _rest(forest: Forest, sets: list[np.ndarray], n: np.ndarray) -> None:
    """Links between groups that the index leaves apart: each set outside the largest group against all others at once."""
    roots, sizes = np.unique(forest.root, return_counts=True)
    if len(roots) == 1:
        return
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], np.repeat(np.arange(len(sets)), n)[by]
    for a in np.flatnonzero(forest.root != roots[np.argmax(sizes)]).tolist():
        first, last = np.searchsorted(flat, sets[a], "left"), np.searchsorted(flat, sets[a], "right")
        run = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero(_alike(both, n[a], n) & (forest.root != forest.root[a]))
        if len(near):
            forest.add(np.full(len(near), a), near)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, low, high, node, sketch, held) sorted by block to spanning links (src, dst)."""
    held: list[tuple] = []
    name = None

    def flush():
        nodes, sketches = (np.array([row[i] for row in held], np.int64) for i in (0, 1))
        root = block_roots(sketches.view(np.uint64), [row[2] for row in held])
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["src", "dst"])

    for batch in batches:
        for pivot, low, high, node, sketch, shingles in zip(*batch.columns, strict=True):
            now = pivot.as_py(), low.as_py(), high.as_py()
            if now != name and held:
                yield from flush()
                held = []
            name = now
            held.append((node.as_py(), sketch.as_py(), np.frombuffer(shingles.as_py(), np.uint64)))
    if held:
        yield from flush()


def _pivots(entries: DataFrame, name: str) -> DataFrame:
    """``key`` and its smallest node as ``pivot``, of the keys of two nodes or more."""
    ends = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("high"))
    return materialize(ends.where("pivot <> high").select("key", "pivot"), name)


def _meetings(prints: DataFrame) -> DataFrame:
    """``pivot``, ``low``, ``high`` (blocks) and ``node``: what meets where."""
    need = F.floor(F.col("n") / SHARE) + 1
    entries = prints.select("node", "n", F.explode("keys").alias("key"))
    keys = _pivots(entries, "prefix_pivots")
    shared = materialize(entries.join(keys, "key").select("key", "node", "n").distinct(), "shared_prefixes")
    enough = shared.groupBy("node", "n").agg(F.count("*").alias("c")).where(F.col("c") >= need).select("node")
    company = materialize(shared.join(enough, "node"), "prefixes_in_company")
    keys_left = _pivots(company, "pivots_in_company")
    met = materialize(company.join(keys_left, "key").groupBy("pivot", "node", "n").agg(F.count("*").alias("c")), "pivots_met")
    dealt = met.groupBy("node").agg(F.count("*").alias("pivots"))
    close = materialize(met.join(dealt, "node").where(F.col("c") * F.col("pivots") >= need).select("pivot", "node", "n"), "close_pivots")
    sizes = close.groupBy("pivot").agg(F.count("*").alias("rows"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("rows > 1")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = close.join(sizes, "pivot").select("pivot", "node", "blocks", mine.alias("mine"))
    other = F.explode(F.expr("if(blocks = 1, array(0), filter(sequence(0, blocks - 1), x -> x <> mine))")).alias("other")
    pairs = placed.select("pivot", "node", "mine", other)
    meetings = materialize(pairs.select("pivot", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node"), "meetings")
    drop(keys, shared, company, keys_left, met, close)
    return meetings


def components(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """``node``, ``component`` of every node with a link."""
    meetings = _meetings(prints)
    wanted = meetings.select("node").distinct()
    first = prints.groupBy("node").agg(F.min("row").alias("row")).join(wanted, "node", "left_semi")
    sets = materialize(texts.join(first, "row").select("node", "text").mapInArrow(lean(_sets), "node bigint, sketch bigint, held binary"), "shingle_sets")
    blocks = meetings.join(sets, "node").select("pivot", "low", "high", "node", "sketch", "held")
    sorted_blocks = blocks.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
    links = materialize(sorted_blocks.mapInArrow(lean(_block_links), "src bigint, dst bigint"), "near_links")
    drop(meetings, sets)
    return connected_components(links)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, joined over any number of links: the first by (id, text hash).

    Rows are told apart, not ids: of rows that are equal one stays, and an id with two texts can keep either, both or none.
    Rows without an id come last in their group. Texts without words are copies of each other. An empty table stays
    empty, and extra columns are kept whatever their names. Runs jobs while it is called.
    """
    row = fresh_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    prints = _prints(texts)
    groups = components(prints, texts)
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    named = materialize(prints.select("row", "node").join(groups, "node", "left").select("row", F.coalesce("component", "node").alias("group")).join(ids, "row"), "rows_by_group")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash", "row")).alias("first")).select(F.col("first.row").alias("row"))
    drop(prints)
    dropped = named.select("row").join(first, "row", "left_anti").withColumnRenamed("row", row)
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)
