"""Best postings from blocks of documents: those that counting and ranking posting by posting give."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery import queries
from gleanery.operators import blocks, index

COLUMNS = ["doc_id", "term", "count", "total", "df", "idf", "tf", "tfidf", "rank"]
ODD = ["", None, "  ", "the and of", "ab c1 x_y", "Rose,ROSE;rose 9rose rose_ éroseé rose", "\U0001f339moss\U0001f339 İris ſtone Kelvin Kelvin", "fern\x00palm퟿ivy", "rose" * 3000]


def _texts(n: int) -> list[tuple[int, str | None]]:
    random.seed(7)
    words = [a + b + c for a in "rmfp" for b in "aeiou" for c in ("ss", "rn", "lm", "se")] + ["the", "über", "x1", "ox"]
    texts = [" ".join(random.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=random.randint(0, 40))) for _ in range(n)]
    return [(i * 3 - 50, t) for i, t in enumerate(texts + ODD)]


def _by_posting(docs, k):
    counts = index.term_counts(docs)
    return index.postings(index.tfidf(counts, index.corpus_size(docs), df=index.document_frequency(docs)), k)


def _rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("k", [1, 3, 500])
def test_best_postings_are_those_of_ranking_all(spark, k):
    docs = spark.createDataFrame(_texts(300), "doc_id long, text string").repartition(7).cache()
    expected = _rows(_by_posting(docs, k))
    assert _rows(index.top_postings(docs, k)) == expected and len(expected) > 60


def test_a_term_of_all_documents_ranks_by_id(spark):
    """Its idf is 0, and so are its scores: the frequency does not count. Documents without any term do not count either."""
    rows = [(i, "moss " * (1 + i % 7) + ("rose" if i % 2 else "fern fern")) for i in range(40, 0, -1)] + [(0, "of"), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = index.top_postings(docs, 4)
    assert _rows(got) == _rows(_by_posting(docs, 4))
    assert [(r.doc_id, r.tfidf) for r in got.where("term = 'moss'").orderBy("rank").collect()] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_repeated_and_other_ids(spark):
    rows = [(1, "red rose rose"), (1, "red moss"), (2, "fern"), (3, "fern fern rose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(index.top_postings(docs, 2)) == _rows(_by_posting(docs, 2))
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert _rows(index.top_postings(named, 2)) == _rows(_by_posting(named, 2))


def test_terms_across_pieces_and_batches(monkeypatch):
    """Texts cut into small pieces, blocks handed over row by row: terms are counted in all of them."""
    texts = [(i, "moss rose" if i % 2 else "moss fern fern") for i in range(50)] + [(50, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])

    def best():
        rows = sorted((r for b in blocks._blocks(iter([batch, batch.slice(0, 0)]), 5, []) for r in b.to_pylist()), key=lambda r: r["term"])
        given = pa.Table.from_pylist([r | {"n_docs": 50} for r in rows])
        return [tuple(r.values()) for b in blocks._merged(iter(given.to_batches(blocks.ROWS)), 5) for r in b.to_pylist()], len(rows)

    whole, n = best()
    monkeypatch.setattr(blocks, "TEXT_BYTES", 40)
    monkeypatch.setattr(blocks, "ROWS", 2)
    pieces, more = best()
    assert pieces == whole and n == 3 and more > 20
    assert {(t, df) for t, df, *_ in whole} == {("moss", 50), ("rose", 25), ("fern", 25)} and len(whole) == 15
    assert [r[3] for r in whole if r[0] == "moss"] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("name", ["min_idf_repair", "term_importance_topn", "important_terms", "postings_top500"])
def test_postings_of_all_terms_come_from_one_reading(spark, tmp_path, name):
    """Terms are neither counted twice nor joined with their counts of documents, and no window sorts all postings."""
    spark.createDataFrame(_texts(20), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.REGISTRY[name][0](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "regexp_extract_all" not in plan and plan.count("RepartitionByExpression") <= 1 + plan.count("lower(text")
