"""Language identification, words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language. A word the model has not seen backs off to its
character n-grams (with borders): of the longest order with any known n-gram, the mean of their log
frequencies. A document's score adds up over all its words.

The model is learned from the texts of at most ``SAMPLE_DOCS`` labelled documents (those with the smallest hash
of their id), counted in Spark; the ``MODEL_WORDS`` and ``MODEL_GRAMS`` most frequent entries, dealt
evenly to the languages, are broadcast. So its size is bounded whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import lean, materialize

#: Bounds of the labelled documents that are learned from, and of the model: each language's most frequent words and n-grams.
SAMPLE_DOCS = 20_000
MODEL_WORDS, MODEL_GRAMS = 120_000, 240_000
MAX_GRAM = 5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000
#: Weight of one n-gram's evidence against a word's, and the number of words at which a score is certain enough (texts are read whole).
GRAM_WEIGHT, SHARP_WORDS = 0.5, 12


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language of words and n-grams."""

    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray | None = None
    _cache: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]) -> LanguageModel:
        """From (language, word or n-gram, count)."""
        self = cls(sorted({lang for lang, _, _ in words}))
        if self.languages:
            self.words, self.word_scores = self._table(words, lambda w: 0)
            self.grams, self.gram_scores = self._table(grams, len)
        return self

    def _table(self, counts, order) -> tuple[dict[str, int], np.ndarray]:
        at = {lang: i for i, lang in enumerate(self.languages)}
        index: dict[str, int] = {}
        for _, key, _ in counts:
            index.setdefault(key, len(index))
        table = np.full((len(index), len(at)), 0.5)
        orders = np.zeros(len(index), np.int64)
        for lang, key, n in counts:
            table[index[key], at[lang]] += n
            orders[index[key]] = order(key)
        for o in np.unique(orders):
            rows = orders == o
            table[rows] = np.log(table[rows] / table[rows].sum(axis=0))
        return index, table

    def backoff(self, word: str) -> np.ndarray | None:
        """Score vector of an unseen word; None if not even its letters are known."""
        for size in range(min(MAX_GRAM, len(word) + 2), 0, -1):
            rows = [r for g in grams_of(word, size) if (r := self.grams.get(g)) is not None]
            if rows:
                return GRAM_WEIGHT * self.gram_scores[rows].mean(axis=0)
        return None

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); (``und``, 0) for a text without letters or a model without languages."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        rows, weights = [], []
        total = np.zeros(len(self.languages))
        for word, n in counts.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
                continue
            vector = self._cache.get(word, False)
            if vector is False:
                if len(self._cache) >= CACHE_WORDS:
                    self._cache.clear()
                vector = self._cache[word] = self.backoff(word)
            if vector is not None:
                total += n * vector
        if rows:
            total += np.asarray(weights, float) @ self.word_scores[rows]
        n = max(1, sum(counts.values()))
        scaled = total / n * min(n, SHARP_WORDS)
        p = np.exp(scaled - scaled.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def held_out(id_column: Column) -> Column:
    """True for ids whose CRC-32 (as decimal text) is 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
        yield from _counted(counts, "word")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counter = counts.setdefault(lang, Counter())
            for size in range(1, MAX_GRAM + 1):
                for gram in grams_of(word, size):
                    counter[gram] += n
        yield from _counted(counts, "gram")


def _counted(counts: dict[str, Counter], name: str) -> Iterator[pa.RecordBatch]:
    for lang, counter in counts.items():
        if counter:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())], ["lang", name, "n"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from the labelled documents of ``docs`` that are not held out."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("i is not null and text is not null and lang is not null")
    rows = rows.where(~held_out(F.col("i")))
    chosen = rows.select("i").orderBy(F.xxhash64("i"), "i").limit(sample_docs).distinct()
    sample = rows.join(F.broadcast(chosen), "i", "left_semi").select("lang", "text")
    words = materialize(sample.mapInArrow(lean(_count_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word_counts")
    grams = words.mapInArrow(lean(_count_grams), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "gram_counts")
    return LanguageModel.build(frequent(words, "word", MODEL_WORDS), frequent(grams, "gram", MODEL_GRAMS))


def frequent(counts: DataFrame, key: str, size: int) -> list[tuple[str, str, int]]:
    """(language, ``key``, count) from the least count of each language at which all languages share ``size`` entries.

    The count comes from a histogram, so no language is ranked in one task. What is rarer is unseen to the model, and
    backs off to its n-grams.
    """
    rows = counts.groupBy("lang", "n").agg(F.count("*").alias("entries")).collect()
    by_lang: dict[str, dict[int, int]] = {}
    for row in rows:
        by_lang.setdefault(row["lang"], {})[row["n"]] = row["entries"]
    kept = F.lit(False)
    for lang, entries in sorted(by_lang.items()):
        room, least = size // len(by_lang), None
        for n in sorted(entries, reverse=True):
            room -= entries[n]
            if room < 0:
                break
            least = n
        if least is not None:
            kept |= (F.col("lang") == lang) & (F.col("n") >= least)
    return sorted((r["lang"], r[key], r["n"]) for r in counts.where(kept).collect())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text where there was nothing
    to learn from. Ties go to the alphabetically first language. Rows that repeat and null ids are kept
    (null ids are neither held out nor learned from). An empty table gives an empty result.
    """
    model = model or learn(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    doc = docs[id_col].cast("bigint")
    source = docs.select(doc.alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id bigint, held_out boolean, lang_pred string, score double")
