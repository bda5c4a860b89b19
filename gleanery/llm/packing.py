"""Packing of token sequences by cutting-stock column generation.

Each document is cut at multiples of the sequence length; what is left over is one piece. The lengths of
all pieces form a histogram of at most ``capacity`` entries, which is all that reaches the driver,
whatever the number of documents. There the cutting-stock linear program (fewest sequences that hold
the histogram) is solved by column generation: the columns are patterns (how many pieces of each length
share a sequence) and a knapsack dynamic program prices new ones on the dual values. Patterns are rounded
down; what rounding leaves is packed by greedy patterns of the same form.

Documents are then ranked within their length (range partitioning by length, local row numbers and
per-partition offsets, so that no length, however frequent, is one task), and each rank range is mapped to
its pattern's sequences through a small table with a row for each pattern and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import lean, materialize
from .tokens import default_path, encoder

CAPACITY = 1024
END_ID = 0


# --- the linear program ----------------------------------------------------------------------


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of largest total value, and that value."""
    useful = np.flatnonzero(values > 1e-12)
    pattern = np.zeros(len(lengths), np.int64)
    if not len(useful):
        return 0.0, pattern
    order = useful[np.argsort(lengths[useful])]
    sizes, worth = lengths[order], values[order]
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(int(sizes[0]), capacity + 1):
        options = best[room - sizes[: fits[room]]] + worth[: fits[room]]
        top = int(options.argmax())
        if options[top] > best[room - 1] + 1e-15:
            best[room], choice[room] = options[top], top
        else:
            best[room] = best[room - 1]
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        pattern[order[choice[room]]] += 1
        room -= int(sizes[choice[room]])
    return float(best[capacity]), pattern


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and fractional multiplicities of a near-optimal basis of the linear program.

    The revised simplex method starts from greedy patterns and stops when the tokens themselves or
    Farley's bound prove the value within ``gap``. Rounding errors only cost padding: the multiplicities
    guide ``plan_patterns``, which counts pieces in whole numbers.
    """
    m = len(lengths)
    basis = np.diag(np.maximum(capacity // lengths, 1)).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = demand / np.diag(basis)
    duals = inverse.sum(axis=0)
    floor = float(demand @ lengths) / capacity

    def enter(pattern: np.ndarray) -> None:
        nonlocal x, duals
        used = np.flatnonzero(pattern)
        column = (inverse[:, used] * pattern[used]).sum(axis=1)
        up = np.flatnonzero(column > 1e-9)
        if not len(up):
            return
        ratios = x[up] / column[up]
        out = int(up[ratios.argmin()])
        step = max(float(ratios.min()), 0.0)
        x -= step * column
        x[out] = step
        np.maximum(x, 0, out=x)
        pivot = inverse[out] / column[out]
        duals += (1 - column.sum()) * pivot
        touched = np.flatnonzero(np.abs(column) > 1e-12)
        inverse[touched] -= np.outer(column[touched], pivot)
        inverse[out] = pivot
        basis[:, out] = pattern

    for pattern, _ in greedy_patterns(lengths, demand, capacity, limit=m):
        if duals @ pattern > 1 + 1e-9:
            enter(pattern)
    for _ in range(rounds):
        total = float(x.sum())
        if total - floor <= gap * total:
            break
        value, pattern = best_pattern(duals, lengths, capacity)
        if value <= 1 + 1e-9:
            break
        floor = max(floor, float(np.maximum(duals, 0) @ demand) / value)
        enter(pattern)
    return basis.T.round().astype(np.int64), x


def greedy_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, limit: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Best-fit-decreasing patterns, each used as often as the counts allow, until the counts are met."""
    left = counts.astype(np.int64).copy()
    order = np.argsort(-lengths)
    made = 0
    while left.any() and (limit is None or made < limit):
        room, pattern = capacity, np.zeros(len(lengths), np.int64)
        for i in order:
            if left[i] > 0 and lengths[i] <= room:
                pattern[i] = min(left[i], room // lengths[i])
                room -= int(pattern[i] * lengths[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        made += 1
        yield pattern, times


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern {length: pieces}, times) that hold every piece of the histogram exactly once."""
    if not histogram:
        return []
    plan: list[tuple[dict[int, int], int]] = []
    if full := histogram.get(capacity):
        plan.append(({capacity: 1}, full))
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    if not len(lengths):
        return plan
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    patterns, x = solve_patterns(lengths, left.astype(float), capacity)

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0:
            left = left - times * pattern
            plan.append(({int(n): int(k) for n, k in zip(lengths[used], pattern[used], strict=True)}, times))

    for i in np.argsort(-x):
        if patterns[i].any() and x[i] >= 1:
            use(patterns[i], int(x[i] + 1e-6))
    for pattern, times in greedy_patterns(lengths, left, capacity):
        use(pattern, times)
    assert not left.any()
    return plan


# --- the Spark side --------------------------------------------------------------------------

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut_documents(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).ids
    end = np.array([end_id], "<u4")
    for batch in batches:
        out: list[list[int | None]] = [[] for _ in range(5)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
            total = len(ids)
            for start in range(0, total, capacity):
                part = ids[start : start + capacity]
                for column, value in zip(out, (doc, start, len(part), zlib.crc32(part), total), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids (its tokens, then ``end_id``), cut at multiples of ``capacity``."""
    path = tokenizer_path or default_path()
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(lean(lambda b: _cut_documents(b, path, capacity, end_id)), _PIECES)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's position among the partition's rows of its length."""
    seen: dict[int, int] = {}
    for batch in batches:
        length = batch.column(2).to_numpy()
        values, first, counts = np.unique(length, return_index=True, return_counts=True)
        base = np.array([seen.get(int(v), 0) for v in values], np.int64)
        at = np.searchsorted(values, length)
        position = base[at] + np.arange(len(length)) - first[at]  # rows come sorted by length
        seen.update(zip(values.tolist(), (base + counts).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(position)], [*batch.schema.names, "position"])


def _assignment(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, pieces in a pattern, first sequence, offset of the first piece)."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            first = used.get(length, 0)
            rows.append((length, first, first + each * times - 1, each, sequence, offset))
            used[length] = first + each * times
            offset += each * length
        sequence += times
    return rows


_ASSIGNMENT = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "first_rank", "last_rank", "each", "first_sequence", "first_offset")])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``cut_pieces``) with ``sequence_id`` and ``offset`` of each.

    The driver gets the histogram of lengths (at most ``capacity`` rows) and the counts by partition and
    length of the sorted pieces (at most ``capacity`` plus the number of partitions).
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    ordered = pieces.repartitionByRange("length", "doc_id", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "start", "ids_crc32").withColumn("part", F.spark_partition_id())
    numbered = materialize(ordered.mapInArrow(lean(_number), _PIECES + ", part int, position bigint"), "numbered_pieces")
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").collect()
    histogram: dict[int, int] = {}
    offsets = []
    for row in counts:
        offsets.append((row.length, row.part, histogram.get(row.length, 0)))
        histogram[row.length] = histogram.get(row.length, 0) + row.n
    plan = plan_patterns(histogram, capacity)
    shift = spark.createDataFrame(offsets, "length long, part int, shift long")
    slots = spark.createDataFrame(_assignment(plan), _ASSIGNMENT)
    ranked = numbered.join(F.broadcast(shift), ["length", "part"]).withColumn("rank", F.col("position") + F.col("shift"))
    placed = ranked.join(F.broadcast(slots), "length").where(F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is one piece, the end id. Rows that repeat an id are documents of their own, and
    null ids are kept. An empty table gives an empty result; extra columns are ignored.
    """
    return pack(cut_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id), capacity)
