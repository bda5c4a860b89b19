"""Exact removal of word passages that occur more than once, by suffix automata of reference shards.

A *window* is ``min_words`` consecutive words of one document. Every word under a window whose word
sequence also starts anywhere else is removed. The reference is the corpus itself, so sending every
shard's automaton to every document would cost shards x documents; instead both sides are dealt by
content, so that a document's passage meets exactly the one shard that can hold its copies:

1. every window's *anchor* is the smallest hash of the ``anchor_words``-grams in it. Equal windows
   have equal anchors. A document emits one row per distinct anchor (about 7 % of its words);
2. anchors that occur once in the corpus (counted with map-side combine) cannot hold a repeat and are
   dropped; the others go back to their documents, which emit the *segments* (runs of windows with one
   anchor, as words) that carry them;
3. equal segments collapse to one row with a count before they are dealt, so a passage copied into a
   third of all documents is one row. Each anchor's distinct segments form a reference shard: its
   suffix automaton, with occurrence counts, is built in the task and the segments are streamed through
   it for matching statistics. Maximal spans whose match occurs twice or more and is long enough go;
4. an anchor with more than ``shard_segments`` distinct segments (many different surroundings of one
   common phrase) would be a hot shard. Its segments go through steps 1 to 3 again with longer anchors,
   most of which occur once. What is hot even then is counted window by window, keyed by a 128-bit
   digest with map-side combine, which no key can make hot. All ways are exact, and no case is left out.

Each step's result is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import gram_hashes, rolling_min, word_hashes
from .scratch import drop, fresh_name, lean, materialize

MIN_WORDS = 35
#: Anchor lengths: of documents, then of the segments of hot anchors.
ANCHOR_WORDS = (8, 24)
SHARD_SEGMENTS = 256


_DIGEST = struct.Struct("<qq")


def split_words(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split() cuts at exactly these six bytes)."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).split()


def _window_anchors(words: list[bytes], min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' anchor grams, and the anchor of every window."""
    grams = gram_hashes(word_hashes(words), anchor_words)
    return grams, rolling_min(grams, min_words - anchor_words + 1)


def _emit_anchors(batches: Iterator[pa.RecordBatch], min_words: int, anchor_words: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, copies) to (k1, k2, anchor, weight): weight 2 where one copy alone may repeat a window of that anchor."""
    for batch in batches:
        at, values, weights = [], [], []
        for row, text in enumerate(batch.column(2)):
            words = split_words(text.as_py())
            if len(words) < min_words:
                continue
            grams, anchors = _window_anchors(words, min_words, anchor_words)
            distinct = np.unique(anchors)
            grams.sort()
            copies = np.searchsorted(grams, distinct, "right") - np.searchsorted(grams, distinct, "left")
            at.append(np.full(len(distinct), row))
            values.append(distinct)
            weights.append(np.minimum(copies, 2) * batch.column(3)[row].as_py())
        if at:
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(weights).astype(np.int64))],
                ["k1", "k2", "anchor", "weight"],
            )


_SEGMENT_TYPES = "k1 bigint, k2 bigint, anchor bigint, s1 bigint, s2 bigint, start int, copies bigint, seg binary"


def _emit_segments(batches: Iterator[pa.RecordBatch], min_words: int, anchor_words: int) -> Iterator[pa.RecordBatch]:
    """The segments of the anchors that repeat: 128-bit digest (s1, s2), first word, copies and words."""
    names = ["k1", "k2", "anchor", "s1", "s2", "start", "copies", "seg"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        held = 0
        for k1, k2, text, copies, wanted in zip(*(batch.column(i) for i in range(5)), strict=True):
            words = split_words(text.as_py())
            anchors = _window_anchors(words, min_words, anchor_words)[1]
            hits = np.sort(np.asarray(wanted.values).view(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
            ends = np.append(first[1:], len(anchors))
            place = np.minimum(np.searchsorted(hits, anchors[first]), len(hits) - 1)
            chosen = hits[place] == anchors[first]
            for start, end, anchor in zip(first[chosen].tolist(), ends[chosen].tolist(), anchors[first[chosen]].view(np.int64).tolist(), strict=True):
                segment = b" ".join(words[start : end + min_words - 1])
                s1, s2 = _DIGEST.unpack(xxhash.xxh3_128_digest(segment))
                for column, value in zip(out, (k1.as_py(), k2.as_py(), anchor, s1, s2, start, copies.as_py(), segment), strict=True):
                    column.append(value)
                held += len(segment)
            if held > 1 << 22:
                yield _segment_batch(out, names)
                out, held = [[] for _ in names], 0
        if out[0]:
            yield _segment_batch(out, names)


def _segment_batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable symbols, with occurrence counts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, sequence, copies: int = 1) -> None:
        """Insert a sequence that occurs ``copies`` times."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            state = nexts[last].get(symbol)
            if state is not None:
                if length[state] == length[last] + 1:
                    last = state
                else:
                    clone = self._clone(last, symbol, state)
                    last = clone
                count[last] += copies
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(copies)
            at = last
            while at >= 0 and symbol not in nexts[at]:
                nexts[at][symbol] = new
                at = link[at]
            if at >= 0:
                state = nexts[at][symbol]
                link[new] = state if length[at] + 1 == length[state] else self._clone(at, symbol, state)
            last = new

    def _clone(self, at: int, symbol, state: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(nexts[state].copy())
        length.append(length[at] + 1)
        link.append(link[state])
        self.count.append(0)
        link[state] = clone
        while at >= 0 and nexts[at].get(symbol) == state:
            nexts[at][symbol] = clone
            at = link[at]
        return clone

    def total(self) -> list[int]:
        """Occurrences of each state's strings: counts summed up along the suffix links."""
        total = self.count.copy()
        for state in sorted(range(1, len(total)), key=self.length.__getitem__, reverse=True):
            total[self.link[state]] += total[state]
        return total

    def repeated_ends(self, sequence, total: list[int], least: int) -> Iterator[int]:
        """Matching statistics: positions after a suffix of ``least`` symbols or more that occurs twice or more."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, symbol in enumerate(sequence, 1):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            while state and total[state] < 2:  # the longest suffix that occurs elsewhere as well
                state = link[state]
                matched = length[state]
            if matched >= least:
                yield at


def _spans(ends, width: int) -> list[int]:
    """Maximal word spans [from, to, from, to, ...] under windows that end at the ascending ``ends``."""
    spans: list[int] = []
    for end in ends:
        if spans and end - width <= spans[-1]:
            spans[-1] = end
        else:
            spans += [end - width, end]
    return spans


def shard_spans(segments: list[tuple[bytes, int]], min_words: int) -> list[list[int]]:
    """Spans of each distinct segment (with its number of copies) of one anchor, through its automaton."""
    ids: dict[bytes, int] = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in text.split()] for text, _ in segments]
    if len(segments) == 1 and segments[0][1] > 1:
        return [[0, len(sequences[0])]]
    automaton = SuffixAutomaton()
    for sequence, (_, copies) in zip(sequences, segments, strict=True):
        automaton.add(sequence, copies)
    total = automaton.total()
    return [_spans(automaton.repeated_ends(s, total, min_words), min_words) for s in sequences]


def _shard_partition(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, s1, s2, copies, seg) sorted by anchor to (s1, s2, spans)."""
    held: list[tuple] = []

    def flush():
        found = shard_spans([(row[4], row[3]) for row in held], min_words)
        rows = [(row[1], row[2], spans) for row, spans in zip(held, found, strict=True) if spans]
        if rows:
            s1, s2, spans = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["k1", "k2", "spans"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield from flush()
                held = []
            held.append(row)
    if held:
        yield from flush()


def _emit_windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, copies) to each window: (k1, k2, copies, end, digest)."""
    for batch in batches:
        for k1, k2, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = split_words(text)
            digests = [xxhash.xxh3_128_digest(b" ".join(words[i : i + min_words])) for i in range(len(words) - min_words + 1)]
            n = len(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(range(min_words, min_words + n), pa.int32()), pa.array(digests, pa.binary())],
                ["k1", "k2", "copies", "end", "digest"],
            )


def _merge_windows(ends, min_words: int):
    """Column of spans from the sorted array of window ends (built-in functions only)."""
    start = F.lit(min_words)
    merged = F.aggregate(
        ends,
        F.array().cast("array<int>"),
        lambda acc, e: F.when((F.size(acc) > 0) & (e - start <= F.element_at(acc, -1)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(e))).otherwise(F.concat(acc, F.array(e - start, e))),
    )
    return F.transform(merged, lambda x: x.cast("int"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (identity of a row by its id and text), doc_id and text."""
    text, doc = docs[text_col].cast("string"), docs[id_col].cast("bigint")
    k2 = F.xxhash64(text)
    return docs.select(F.coalesce(doc, F.xxhash64(F.lit("no id"), text)).alias("k1"), k2.alias("k2"), doc.alias("doc_id"), text.alias("text"))


def _window_spans(texts: DataFrame, min_words: int) -> DataFrame:
    """Spans of rows (k1, k2, text, copies), counted window by window."""
    windows = materialize(texts.mapInArrow(lean(lambda b: _emit_windows(b, min_words)), "k1 bigint, k2 bigint, copies bigint, end int, digest binary"), "hot_windows")
    twice = materialize(windows.groupBy("digest").agg(F.sum("copies").alias("n")).where("n > 1").select("digest"), "repeated_windows")
    ends = windows.join(twice, "digest").groupBy("k1", "k2").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    return ends.select("k1", "k2", _merge_windows(F.col("ends"), min_words).alias("spans"))


def _anchor_spans(texts: DataFrame, min_words: int, anchor_words: tuple[int, ...], shard_segments: int) -> DataFrame:
    """``spans`` (flat word positions) of parts of rows (k1, k2, text, copies) whose windows repeat."""
    if not anchor_words:
        return _window_spans(texts, min_words)
    size, longer = anchor_words[0], anchor_words[1:]
    anchors = materialize(texts.mapInArrow(lean(lambda b: _emit_anchors(b, min_words, size)), "k1 bigint, k2 bigint, anchor bigint, weight bigint"), "anchors")
    # written first: a join of two plain scans can be split where one anchor is hot
    repeated = materialize(anchors.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor"), "repeated")
    wanted = anchors.join(repeated, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("wanted"))
    joined = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "copies", "wanted")
    segments = materialize(joined.mapInArrow(lean(lambda b: _emit_segments(b, min_words, size)), _SEGMENT_TYPES), "segments")
    drop(anchors, repeated)
    distinct = materialize(segments.groupBy("anchor", "s1", "s2", "seg").agg(F.sum("copies").alias("copies")).select("anchor", "s1", "s2", "copies", "seg"), "distinct_segments")
    shards = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("n")), "shards")
    hot = shards.where(F.col("n") > shard_segments).select("anchor")
    calm = distinct.join(shards.where(F.col("n") <= shard_segments).select("anchor"), "anchor").select(distinct.columns)
    dealt = calm.repartition("anchor").sortWithinPartitions("anchor")
    spans = dealt.mapInArrow(lean(lambda b: _shard_partition(b, min_words)), "k1 bigint, k2 bigint, spans array<int>")
    if not hot.isEmpty():
        again = materialize(distinct.join(hot, "anchor").select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("seg").alias("text"), "copies"), "hot_segments")
        spans = spans.unionByName(_anchor_spans(again, min_words, longer, shard_segments))
    spans = materialize(spans.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "spans"), "segment_spans")
    drop(distinct, shards)
    moved = F.transform("spans", lambda x: x + F.col("start"))
    parts = materialize(segments.select("k1", "k2", "s1", "s2", "start").join(spans, ["s1", "s2"]).select("k1", "k2", moved.alias("spans")), "document_spans")
    drop(segments, spans)
    return parts


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor_words: tuple[int, ...] = ANCHOR_WORDS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """``k1``, ``k2`` and ``spans`` (sorted [lo, hi) word spans as structs) of documents with repeats."""
    texts = _keyed(docs, id_col, text_col).where("text is not null").select("k1", "k2", "text", F.lit(1).cast("bigint").alias("copies"))
    parts = _anchor_spans(texts, min_words, anchor_words, shard_segments)
    pairs = F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> struct(spans[2 * i] as lo, spans[2 * i + 1] as hi))")
    return parts.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))).alias("spans"))


def _kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    kept: list[bytes] = []
    at = 0
    for span in spans:
        kept += words[at : max(at, span["lo"])]
        at = max(at, span["hi"])
    return kept + words[at:]


def kept(text: str, spans: list[dict]) -> str:
    """``text`` without the words under ``spans``, the others joined by one space."""
    return b" ".join(_kept_words(split_words(text), spans)).decode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to (doc_id, n_words, n_removed, kept_sha256)."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            words = split_words(text.as_py())
            stay = _kept_words(words, spans.as_py()) if spans.is_valid else words
            values = (len(words), len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``.

    ``kept_sha256`` is of the kept words joined by one space. A null text has no words; shorter texts
    than a window keep all words. Rows that repeat an id and a text are documents of their own, so their
    windows repeat. Null ids are kept. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, id_col, text_col, min_words, **options)
    joined = _keyed(docs, id_col, text_col).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lean(_cut), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def replace_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``docs`` with all its columns, the text of documents with repeats replaced by the kept words.

    Texts without repeats stay as they are; a text that is all repeats becomes empty.
    """
    spans = repeated_spans(docs, id_col, text_col, min_words, **options)
    one, two = fresh_name(docs, "_k1"), fresh_name(docs, "_k2")
    text, doc = docs[text_col].cast("string"), docs[id_col].cast("bigint")
    keyed = docs.withColumns({one: F.coalesce(doc, F.xxhash64(F.lit("no id"), text)), two: F.xxhash64(text)})
    there = spans.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("spans").alias(fresh_name(docs, "_spans")))
    joined = keyed.join(there, [one, two], "left").drop(one, two)
    at = docs.columns.index(text_col)
    return joined.mapInArrow(lean(lambda b: _replace(b, at)), docs.schema)


def _replace(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [kept(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)]
        columns = [*batch.columns[:-1]]
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
