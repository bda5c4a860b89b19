"""Edit-aware token counts: a segment tree over each document's pre-token segments.

A document is cut at places where the tokenizer's pre-tokens always break (a single space between two
other characters), into leaves of at least ``LEAF_CHARS`` characters. Leaves hold their token
counts; inner nodes hold sums. An edit re-encodes the leaves it touches, and neighbours as long as the edit left
no safe cut towards them, and updates the sums on the way to the root. A leaf that edits have made ``GROWTH`` times as
long is cut anew where it can be (a text without any space stays one leaf, which each edit re-encodes).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean
from .tokens import Encoder, default_path, encoder

LEAF_CHARS, GROWTH = 512, 8


def _safe(before: str, after: str) -> bool:
    """Whether pre-tokens never cross from ``before`` to ``after``."""
    return bool(before) and len(after) > 1 and not before[-1].isspace() and after[0] == " " and not after[1].isspace()


def _leaves(text: str, size: int) -> Iterator[str]:
    start = 0
    at = text.find(" ", size)
    while at > 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            yield text[start:at]
            start = at
            at = text.find(" ", start + size)
        else:
            at = text.find(" ", at + 1)
    yield text[start:]


class TokenTree:
    """Token count of a text under edits."""

    def __init__(self, text: str, tokenizer: Encoder, leaf_chars: int = LEAF_CHARS):
        self.tokenizer = tokenizer
        self.leaf_chars = leaf_chars
        self.encoded_chars = 0
        self._build([(part, self._count(part)) for part in _leaves(text, leaf_chars)])
        self.encoded_chars = 0

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        """The tree over counted leaves; nothing is encoded."""
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.texts = [text for text, _ in leaves] + [""] * (self.size - len(leaves))
        self.tokens = [0] * (2 * self.size)
        self.chars = [0] * (2 * self.size)
        for leaf, (text, tokens) in enumerate(leaves):
            self.tokens[self.size + leaf], self.chars[self.size + leaf] = tokens, len(text)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _count(self, text: str) -> int:
        self.encoded_chars += len(text)
        return self.tokenizer.count(text)

    def _sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, offset: int) -> tuple[int, int]:
        """Leaf that holds the character at ``offset`` (the last leaf with text at the end), and the offset in it."""
        node = 1
        while node < self.size:
            node *= 2
            if offset >= self.chars[node] and self.chars[node + 1]:
                offset -= self.chars[node]
                node += 1
        return node - self.size, offset

    def _set(self, leaf: int, text: str) -> None:
        self.texts[leaf] = text
        node = self.size + leaf
        self.tokens[node], self.chars[node] = self._count(text), len(text)
        while node > 1:
            node //= 2
            self._sum(node)

    def _neighbour(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.size:
            if self.texts[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters [start, end) (clipped to the text) by ``replacement``."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        first, in_first = self._find(start)
        last, in_last = self._find(end)
        text = self.texts[first][:in_first] + replacement + self.texts[last][in_last:]
        left, right = self._neighbour(first, -1), self._neighbour(last, 1)
        while left is not None and not _safe(self.texts[left], text):
            text, first = self.texts[left] + text, left
            left = self._neighbour(first, -1)
        while right is not None and not _safe(text, self.texts[right]):
            text, last = text + self.texts[right], right
            right = self._neighbour(last, 1)
        for leaf in range(first + 1, last + 1):
            if self.texts[leaf]:
                self._set(leaf, "")
        parts = list(_leaves(text, self.leaf_chars)) if len(text) > GROWTH * self.leaf_chars else [text]
        if len(parts) == 1:
            self._set(first, text)
            return
        old = [(x, n) for x, n in zip(self.texts, self.tokens[self.size :], strict=True)]
        new = [(part, self._count(part)) for part in parts]
        self._build([leaf for leaf in [*old[:first], *new, *old[first + 1 :]] if leaf[0]])


Edit = tuple[int | None, int | None, str | None]
_SCHEMA = "doc_id bigint, n_tokens bigint, n_edits bigint, edited_tokens bigint, reencoded_chars bigint, edited_chars bigint"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def edited_count(text: str | None, edits: Iterable[Edit], tokenizer: Encoder, leaf_chars: int = LEAF_CHARS) -> tuple[int, int, int, int, int]:
    """(tokens, edits, tokens after them, characters encoded again, characters after them)."""
    tree = TokenTree(text or "", tokenizer, leaf_chars)
    before, n = tree.count, 0
    for start, end, replacement in edits:
        start = start or 0
        tree.edit(start, start if end is None else end, replacement or "")
        n += 1
    return before, n, tree.count, tree.encoded_chars, tree.chars[1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)


def counts_with(docs: DataFrame, edits_col: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Counts before and after the edits in ``edits_col``: an array of (start, end, replacement), applied in order.

    A null array is no edit. Offsets are code points of the text as edited so far and are clipped to it; a
    null start is 0, a null end the start, a null replacement or text is empty. Each row gives a row, rows that repeat and
    null ids too; an empty table gives an empty result, and texts of any length are counted whole. Extra columns are ignored.
    """
    path = tokenizer_path or default_path()

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc, text, edits in zip(ids, batch.column(1), batch.column(2), strict=True):
                changes = [tuple(e.values()) if e else (None, None, None) for e in edits.as_py() or []]
                rows.append((doc, *edited_count(text.as_py(), changes, encoder(path))))
            if rows:
                yield _batch(rows)

    return docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string"), docs[edits_col]).mapInArrow(lean(run), _SCHEMA)


def counts_after(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str = "seq", tokenizer_path: str | None = None) -> DataFrame:
    """``counts_with`` for a table of edits (``doc_id``, ``seq``, ``start``, ``end``, ``replacement``).

    Documents and edits are sorted together and stream by, so a document's edits are never gathered. Edits
    of unknown documents are left out, and those of an id that repeats are applied to each of its rows; equal rows
    share one tree. Null ids have no edits. Ties of ``seq`` go by start, end and replacement.
    """
    path = tokenizer_path or default_path()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(docs[id_col].cast("bigint").alias("d"), F.xxhash64(text).alias("h"), text.alias("t"))
    first = keyed.select("d", "h", F.lit(0).alias("k"), "t", *(F.lit(None).cast("bigint").alias(c) for c in "nse"))
    then = edits.select(F.col(id_col).cast("bigint").alias("d"), F.lit(1).alias("k"), F.col("replacement").cast("string").alias("t"), *(F.col(c).cast("bigint").alias(a) for c, a in ((order_col, "n"), ("start", "s"), ("end", "e"))))
    texts_of = keyed.where("d is not null").select("d", "h").distinct()
    rows = first.unionByName(then.join(texts_of, "d")).repartition("d", "h").sortWithinPartitions("d", "h", "k", "n", "s", "e", "t")

    def run(batches):
        tree = name = None
        before = n = copies = 0

        def counted():
            return [(name[0], before, n, tree.count, tree.encoded_chars, tree.chars[1])] * copies

        for batch in batches:
            out = []
            for d, h, k, text, _, start, end in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if k == 0 and tree is not None and name == (d, h):
                    copies += 1
                elif k == 0:
                    if tree is not None:
                        out += counted()
                    tree, name, n, copies = TokenTree(text, encoder(path)), (d, h), 0, 1
                    before = tree.count
                else:
                    start = start or 0
                    tree.edit(start, start if end is None else end, text or "")
                    n += 1
            if out:
                yield _batch(out)
        if tree is not None:
            yield _batch(counted())

    return rows.mapInArrow(lean(run), _SCHEMA)
