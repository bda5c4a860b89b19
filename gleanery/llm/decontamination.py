"""Benchmark decontamination: documents that hold a benchmark item within a bounded edit distance.

Texts are compared as lower-cased words without ASCII punctuation. An item of ``n`` words matches a
passage whose word edit distance is at most ``d = floor(max_edit_share * n)`` (0.2: similarity 0.8); an item
under five words only matches its very words. A character of a script written without spaces is a word.

* *Windows.* Of ``d + 1`` disjoint pieces of an item, ``d`` edits leave one intact. A document's positions
  of such pieces fix where item-sized windows can start (up to ``d`` words either way); no other
  window of the document can match, so nothing is lost.
* *CGK embedding.* Each window is embedded by a random walk over its words: at each step the current
  word is written out, and a random bit of the step and the word says whether to move on. Walks over
  two word sequences that differ by an edit fall into step again, so a small edit distance becomes a small Hamming
  distance.
* *Bit-sampling LSH.* ``BANDS`` keys, each of ``SAMPLES`` sampled positions of the embedding, from each of
  ``WALKS`` walks, are looked up among the items' keys. At the largest allowed distance about half of the
  positions agree; a key then agrees with probability 1/4, and one of 48 with probability over 0.999 were
  they independent. ``tests/llm/test_decontamination.py`` measures recall over brute force.
* *Verification.* Candidates are verified by the exact word edit distance of the item to the best passage.

Items are broadcast in blocks of at most ``BLOCK_WORDS`` words, one scan of the documents per block;
documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import gram_hashes, mix, word_hashes
from .scratch import lean

MAX_EDIT_SHARE = 0.2
BLOCK_WORDS = 1_000_000
WALKS, BANDS, SAMPLES = 4, 12, 2
_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]")
_TABLE = bytes(0x20 if _PUNCTUATION.match(bytes([b])) else b for b in range(256))
#: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_END = np.uint64(0x5851F42D4C957F2D)


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation counts as white space, an unspaced script's character as a word."""
    if text and not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def edit_passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``region`` nearest to ``item``; the earliest of equals."""

    def ends(pattern: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
        at = np.arange(len(text) + 1)
        row = np.zeros(len(text) + 1, np.int64) if free_start else at.copy()
        for i, symbol in enumerate(pattern, 1):
            new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != symbol)]))
            row = np.minimum.accumulate(new - at) + at
        return row

    last = ends(item, region, True)
    end = int(last.argmin())
    back = ends(item[::-1], region[:end][::-1], False)
    return int(last[end]), end - int(np.flatnonzero(back == last[end])[-1]), end


def cgk_keys(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LSH keys (windows x WALKS * BANDS) of the windows symbols[start : start + size]."""
    keys = np.empty((len(starts), WALKS * BANDS), np.uint64)
    steps = 2 * int(sizes.max(initial=1))
    rows = np.arange(len(starts))
    last = len(symbols) - 1
    for walk in range(WALKS):
        rng = np.random.default_rng(1000 + walk)
        flips = rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        places = rng.random((BANDS, SAMPLES))
        out = np.empty((len(starts), steps), np.uint64)
        at = np.zeros(len(starts), np.int64)
        for step in range(steps):
            symbol = np.where(at < sizes, symbols[np.minimum(starts + at, last)], _END)
            out[:, step] = symbol
            at += (((symbol ^ (symbol >> np.uint64(29))) * flips[step % 4096]) >> np.uint64(63)).astype(np.int64)
        for band in range(BANDS):
            key = np.full(len(starts), np.uint64(walk * BANDS + band + 1))
            for sample in range(SAMPLES):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + out[rows, (places[band, sample] * 2 * sizes).astype(np.int64)])
            keys[:, walk * BANDS + band] = mix(key + sizes.astype(np.uint64))
    return keys


def _united(ranges: np.ndarray) -> np.ndarray:
    """Closed ranges (first, last) as ranges that are apart and in order."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    fresh = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > reach[:-1] + 1]))
    return np.stack([ranges[fresh, 0], np.append(reach[fresh[1:] - 1], reach[-1])], axis=1)


def _within(ranges: np.ndarray) -> np.ndarray:
    """All numbers of ranges that are apart and in order."""
    sizes = ranges[:, 1] - ranges[:, 0] + 1
    return np.repeat(ranges[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class ItemIndex:
    """Pieces and LSH keys of one block of items."""

    ids: list[int | None]
    words: list[np.ndarray]
    edits: list[int]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    keys: np.ndarray | None = None
    key_items: np.ndarray | None = None

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]], max_edit_share: float) -> ItemIndex:
        split = [(i, w) for i, t in items if (w := normal_words(t))]
        self = cls([i for i, _ in split], [word_hashes(w) for _, w in split], [int(max_edit_share * len(w) + 1e-9) for _, w in split])
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item, (words, edits) in enumerate(zip(self.words, self.edits, strict=True)):
            size = len(words) // (edits + 1)
            hashes = gram_hashes(words, size)
            for piece in range(edits + 1):
                pieces.setdefault(size, []).append((int(hashes[piece * size]), item, piece * size))
        for size, found in pieces.items():
            found.sort()
            hashes = np.array([h for h, _, _ in found], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[hashes >> np.uint64(44)] = True
            self.grams[size] = hashes, np.array([i for _, i, _ in found]), np.array([o for _, _, o in found]), seen
        if split:
            sizes = np.array([len(w) for w in self.words])
            keys = cgk_keys(np.concatenate(self.words), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            order = np.argsort(keys.ravel(), kind="stable")
            self.keys, self.key_items = keys.ravel()[order], np.repeat(np.arange(len(sizes)), keys.shape[1])[order]
        return self

    def windows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, size) of the item-sized windows that an intact piece allows.

        Ranges of starts are united by item length as they come, so a phrase that many items share costs its places.
        """
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        edits = np.asarray(self.edits, np.int64)
        allowed: dict[int, np.ndarray] = {}  # by length: ranges of starts, apart and in order
        first = np.full(len(self.words), -1)  # of items without edits: their first passage is their best
        for size, (hashes, items, offsets, seen) in self.grams.items():
            grams = gram_hashes(symbols, size)
            at = np.flatnonzero(seen[grams >> np.uint64(44)])
            low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            hit = high > low
            at, low, counts = at[hit], low[hit], (high - low)[hit]
            ends = np.cumsum(counts)
            done = 0
            while done < len(at):  # portions of bounded size
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 16), "right")))
                many = counts[done:upto]
                entry = np.repeat(low[done:upto] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                item, start = items[entry], np.repeat(at[done:upto], many) - offsets[entry]
                exact = edits[item] == 0
                fresh, place = np.unique(item[exact], return_index=True)
                new = first[fresh] < 0
                first[fresh[new]] = start[exact][place[new]]
                item, start = item[~exact], start[~exact]
                low_end, high_end = np.maximum(0, start - edits[item]), np.minimum(start + edits[item], len(symbols) - 1)
                inside = low_end <= high_end
                for length in np.unique(lengths[item[inside]]).tolist():
                    mine = inside & (lengths[item] == length)
                    more = np.stack([low_end[mine], high_end[mine]], axis=1)
                    allowed[length] = _united(np.concatenate([allowed[length], more]) if length in allowed else more)
                done = upto
        found = [(_within(ranges), length) for length, ranges in allowed.items()]
        exact = np.flatnonzero(first >= 0)
        starts = np.concatenate([np.empty(0, np.int64), first[exact], *(at for at, _ in found)])
        sizes = np.concatenate([np.empty(0, np.int64), lengths[exact], *(np.full(len(at), length) for at, length in found)])
        if not len(starts):
            return starts, sizes
        starts, sizes = np.unique(np.stack([starts, sizes], axis=1), axis=0).T
        return starts, sizes

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(row, item id, distance, start word, end word) of the best passage for each item found."""
        if self.keys is None:
            return
        batch: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for row, text in enumerate(texts):
            symbols = word_hashes(normal_words(text))
            starts, sizes = self.windows(symbols)
            if len(starts):
                batch.append((row, symbols, starts, sizes))
                held += len(starts) + len(symbols) // 64
            if held > 1 << 12:
                yield from self._candidates(batch)
                batch, held = [], 0
        if batch:
            yield from self._candidates(batch)

    def _candidates(self, batch: list) -> Iterator[tuple[int, int | None, int, int, int]]:
        base = np.concatenate([[0], np.cumsum([len(s) for _, s, _, _ in batch])])
        symbols = np.concatenate([s for _, s, _, _ in batch])
        owner = np.repeat(np.arange(len(batch)), [len(s) for _, _, s, _ in batch])
        starts = np.concatenate([s for _, _, s, _ in batch])
        sizes = np.concatenate([s for _, _, _, s in batch])
        regions: dict[tuple[int, int], list[int]] = {}
        for part in range(0, len(starts), 1 << 12):
            cut = slice(part, part + (1 << 12))
            end = np.minimum(sizes[cut], base[owner[cut] + 1] - base[owner[cut]] - starts[cut])
            # a window at the document's end is shorter than its item, but keyed by the item's size
            keys = self._keys(symbols, base[owner[cut]] + starts[cut], sizes[cut], end)
            low = np.searchsorted(self.keys, keys.ravel(), "left")
            high = np.searchsorted(self.keys, keys.ravel(), "right")
            hit = np.flatnonzero(high > low)
            for window, lo, hi in zip((hit // keys.shape[1] + part).tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                for item in set(self.key_items[lo:hi].tolist()):
                    regions.setdefault((int(owner[window]), item), []).append(int(starts[window]))
        for (doc, item), at in sorted(regions.items()):
            row, words, _, _ = batch[doc]
            found = self._verify(item, words, sorted(set(at)))
            if found:
                yield (row, self.ids[item], *found)

    @staticmethod
    def _keys(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if (lengths == sizes).all():
            return cgk_keys(symbols, starts, sizes)
        padded = np.where(np.arange(sizes.max()) < lengths[:, None], symbols[np.minimum(starts[:, None] + np.arange(sizes.max()), len(symbols) - 1)], _END)
        return cgk_keys(padded.ravel(), np.arange(len(starts)) * padded.shape[1], sizes)

    def _verify(self, item: int, symbols: np.ndarray, starts: list[int]) -> tuple[int, int, int] | None:
        words, edits = self.words[item], self.edits[item]
        for start in starts:
            if np.array_equal(symbols[start : start + len(words)], words):
                return 0, start, start + len(words)
        best = None
        reach = 2 * edits + len(words)
        low = high = None
        for start in [*starts, None]:
            if high is not None and (start is None or start - edits > high):
                distance, s, e = edit_passage(words, symbols[low:high])
                if distance <= edits and (best is None or distance < best[0]):
                    best = distance, s + low, e + low
                low = high = None
            if start is not None:
                low = max(0, start - edits) if low is None else low
                high = min(len(symbols), start + reach)
        return best


_SCHEMA = "doc_id bigint, item_id bigint, edit_distance bigint, start_word bigint, end_word bigint"


def _blocks(items: DataFrame, item_id: str, item_text: str, max_edit_share: float) -> Iterator[ItemIndex]:
    block: list[tuple[int | None, str | None]] = []
    words = 0
    for row in items.select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        words += len((row[1] or "").split())
        if words > BLOCK_WORDS:
            yield ItemIndex.build(block, max_edit_share)
            block, words = [], 0
    yield ItemIndex.build(block, max_edit_share)


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_edit_share: float = MAX_EDIT_SHARE) -> DataFrame:
    """One row per row of ``docs`` and item that it holds: ids, word edit distance and the passage's words.

    Null texts and items, and those without words, match nothing. Rows that repeat
    an id each give their rows; null ids are kept. Empty tables give an empty result.
    """
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = None
    for index in _blocks(items, item_id, item_text, max_edit_share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[row], *rest) for row, *rest in shared.value.matches(batch.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "edit_distance", "start_word", "end_word"])

        part = source.mapInArrow(lean(scan), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", max_edit_share: float = MAX_EDIT_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item.

    Null and empty texts hold none and stay; of rows that repeat, all or none stay; texts of any length are read whole. Empty
    tables of documents or items leave ``docs`` as it is, and extra columns are kept whatever their names.
    """
    at = docs.columns.index(text_col)
    for index in _blocks(items, "item_id", "text", max_edit_share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                held = {row for row, *_ in shared.value.matches(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(lean(scan), docs.schema)
    return docs
