"""The best documents of every term: one reading of the documents, one shuffle, no row for each term of each document before it.

Built-in functions count a document's terms element by element, read the documents once more for ``df``, and sort a row for every posting;
that took most of the time of the queries over all postings. Here a batch of documents is tokenised, counted and cut at once (Arrow and numpy) and leaves
as one row for each of its terms, a block. Blocks of a term meet by one shuffle, in term order, and are merged as they stream by. Scores are computed by Spark.

A posting that is not among the best ``k`` of its batch is not among the best ``k`` of all, so nothing else is cut. The order is that of the scores:
within a term these are its frequencies times one ``idf``, and distinct frequencies give distinct scores (fractions of less than 2 ** 25 terms differ
by more than a double's precision). Only where the ``idf`` is 0, for a term of all documents, are all scores equal and the order that of the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import QUERY_STOPWORDS

if TYPE_CHECKING:
    import pyarrow as pa

#: Bytes of text that are counted at once, or one longer text, and rows that are handed over at once: these bound a worker's memory.
TEXT_BYTES, ROWS = 32 << 20, 20_000
_BLOCK = "term string, df bigint, doc_ids array<bigint>, counts array<bigint>, totals array<bigint>"
_BEST = "term string, df bigint, n_docs bigint, doc_id bigint, count bigint, total bigint, rank int"
#: Kinds of bytes: letters, other characters of tokens (digits and the underscore), and what is between tokens.
_BETWEEN, _LETTER, _OTHER = 0, 1, 2
_KIND = np.array([_LETTER if chr(b) in "abcdefghijklmnopqrstuvwxyz" else _OTHER if chr(b) in "0123456789_" else _BETWEEN for b in range(256)], np.uint8)


def best_postings(docs: DataFrame, size: DataFrame, k: int, stopwords=QUERY_STOPWORDS, log: Callable[[Column], Column] = F.ln) -> DataFrame:
    """The rows of ``postings(tfidf(term_counts(...)), k)`` for documents with one row for each id (``united``).

    ``docs``: ``doc_id`` (a whole number; rows without one are left out), ``text``; ``size`` is ``corpus_size``.
    """
    stop = sorted(set(stopwords))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    blocks = texts.mapInArrow(lambda batches: _blocks(batches, k, stop), _BLOCK)
    dealt = blocks.crossJoin(F.broadcast(size.select(F.col("n_docs").cast("bigint").alias("n_docs")))).repartition("term").sortWithinPartitions("term")
    best = dealt.mapInArrow(lambda batches: _merged(batches, k), _BEST)
    idf, tf = log(F.col("n_docs") / F.greatest(F.col("df"), F.lit(1))), F.try_divide(F.col("count").cast("double"), F.col("total").cast("double"))
    weighted = best.select("term", "doc_id", "count", "total", "df", idf.alias("idf"), tf.alias("tf"), "rank")
    return weighted.withColumn("tfidf", F.col("tf") * F.col("idf"))


def _starts(groups: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))


def _ranked(group: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks from 1) of the best ``k`` of each group by falling score, then document; groups in rising order."""
    order = np.lexsort((doc, -score, group))
    first = _starts(group[order])
    rank = np.arange(1, len(order) + 1) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank <= k], rank[rank <= k]


def _blocks(batches: Iterator[pa.RecordBatch], k: int, stop: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_BYTES
        first = _starts(part)
        for start, end in zip(first, np.append(first[1:], len(part)), strict=True):
            piece = batch.slice(start, end - start)
            block = _block(piece.column(0).to_numpy(zero_copy_only=False), pc.fill_null(piece.column(1).cast(pa.string()), ""), k, stop)
            for at in range(0, block.num_rows if block else 0, ROWS):
                yield block.slice(at, ROWS)


def _words(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Tokens of three letters or more, of letters only, of lower-cased texts, and the row of each: see ``functions.text.terms``."""
    import pyarrow as pa

    _, offsets, data = texts.buffers()
    limits = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data, limits = data.slice(limits[0], limits[-1] - limits[0]), limits - limits[0]
    kind = _KIND[np.frombuffer(data, np.uint8)]
    cut = np.ones(len(kind) + 1, bool)
    np.not_equal(kind[1:] > 0, kind[:-1] > 0, out=cut[1:-1])
    cut[limits] = True
    at = np.flatnonzero(cut).astype(np.int32)
    others = np.concatenate((np.zeros(1, np.int32), np.cumsum(kind != _LETTER, dtype=np.int32)))[at]
    fits = (np.diff(others) == 0) & (np.diff(at) > 2)
    found = pa.StringArray.from_buffers(len(fits), pa.py_buffer(at), data).filter(pa.array(fits)).dictionary_encode()
    return found, np.searchsorted(limits, at[:-1][fits], side="right") - 1


def _block(ids: np.ndarray, texts: pa.StringArray, k: int, stop: list[str]) -> pa.RecordBatch | None:
    """A row for each term: in how many of these documents it is, and the best ``k`` of them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
        return None
    words, rows = _words(texts)
    codes = words.indices.to_numpy()
    kept = ~pc.is_in(words.dictionary, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)[codes]
    codes, rows = codes[kept], rows[kept]
    if not len(codes):
        return None
    totals = np.bincount(rows, minlength=len(ids))
    pairs, counts = np.unique(codes.astype(np.int64) * len(ids) + rows, return_counts=True)
    code, row = np.divmod(pairs, len(ids))
    first = _starts(code)
    df = np.diff(np.append(first, len(code)))
    chosen = np.repeat(df <= k, df)
    many = np.flatnonzero(~chosen)
    if len(many):
        tf, doc = counts[many] / totals[row[many]], ids[row[many]]
        chosen[many[_ranked(code[many], tf, doc, k)[0]]] = True
        everywhere = np.flatnonzero(np.repeat(df == np.count_nonzero(totals), df)[many])  # if it is in all others too, the ids decide
        if len(everywhere):
            chosen[many[everywhere[_ranked(code[many][everywhere], np.zeros(len(everywhere)), doc[everywhere], k)[0]]]] = True
    row, offsets = row[chosen], np.append(0, np.add.reduceat(chosen, first, dtype=np.int32).cumsum()).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int64))) for v in (ids[row], counts[chosen], totals[row])]
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(df.astype(np.int64)), *lists], ["term", "df", "doc_ids", "counts", "totals"])


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each term from its blocks, which follow each other; the last term of a batch waits for the next batch."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_batches([held, batch]) if held else batch
        codes = held.column(0).dictionary_encode().indices.to_numpy()
        last = int(np.searchsorted(codes, codes[-1]))
        if last:
            yield from _merge(held.slice(0, last), k)
        held = held.slice(last)
    if held:
        yield from _merge(held, k)


def _merge(blocks: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa
    import pyarrow.compute as pc

    terms = blocks.column(0).dictionary_encode()
    codes = terms.indices.to_numpy()
    first = _starts(codes)
    df, n_docs = np.add.reduceat(blocks.column(1).to_numpy(), first), blocks.column(5).to_numpy()[first]
    doc, count, total = (blocks.column(i).flatten().to_numpy() for i in (2, 3, 4))
    code = np.repeat(codes, pc.list_value_length(blocks.column(2)).to_numpy())
    places, rank = _ranked(code, np.where((df < n_docs)[code], count / total, 0.0), doc, k)
    code = code[places]
    columns = [df[code], n_docs[code], doc[places], count[places], total[places], rank.astype(np.int32)]
    for at in range(0, len(places), ROWS):
        part = slice(at, at + ROWS)
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[part])), *(pa.array(c[part]) for c in columns)], ["term", "df", "n_docs", "doc_id", "count", "total", "rank"])
