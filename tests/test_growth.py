"""Whole results where ids repeat, lists are long and words are many; counts that need no shuffle."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from gleanery import queries
from gleanery.functions.text import to_fixed
from gleanery.operators import index, kvstore, ngram_index
from gleanery.operators.rowwise import explode_computed
from gleanery.sources.tables import table
from gleanery.streaming import incremental


def _counted(df):
    return {tuple(r) for r in df.collect()}



def test_distinct_terms_of_a_long_text(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda i: F.translate(F.format_string("w%06d", i), "0123456789", "abcdefghij")), " ")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), words.alias("text"))
    began = time.time()
    got = index.term_counts(docs, denominator="distinct").agg(F.count("*"), F.min("total"), F.max("count")).first()
    assert tuple(got) == (40_000, 40_000, 1) and time.time() - began < 30


def test_counts_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "red rose rose"), (1, "red moss"), (2, "fern"), (3, None), (3, "fern fern")], "doc_id long, text string")
    got = _counted(index.term_counts(docs).select("doc_id", "term", "count", "total"))
    assert got == {(1, "red", 2, 5), (1, "rose", 2, 5), (1, "moss", 1, 5), (2, "fern", 1, 1), (3, "fern", 2, 2)}
    grams = _counted(ngram_index.local_index(docs.where("doc_id = 1"), F.col("doc_id"), F.col("text"), stemmed=False, n=2))
    assert grams == {("red", "1", 2), ("rose", "1", 2), ("moss", "1", 1), ("red rose", "1", 1), ("rose rose", "1", 1), ("red moss", "1", 1)}


def test_a_term_of_many_documents_is_one_line(spark):
    postings = spark.range(12_000).select(F.lit("moss").alias("term"), F.col("id").cast("string").alias("url"), (F.col("id") % 3 + 9).alias("freq"))
    lines = ngram_index.term_lines(postings).collect()
    expected = sorted(((-(i % 3 + 9), str(i)) for i in range(12_000)))
    assert [(r.term, r.postings) for r in lines] == [("moss", " ".join(f"{u} {-k}" for k, u in expected))]


def test_the_merged_index_holds_terms_of_one_document(spark, tmp_path):
    docs = [(i, "moss rose", "s") for i in range(10_050)] + [(10_050, "fern", "s"), (10_051, "palm", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term: r.postings for r in queries.ngram_index_merge(spark, str(tmp_path)).collect()}
    assert set(got) == {"moss", "rose", "moss rose", "fern", "palm"} and got["fern"] == "10050 2" and got["palm"] == "10051 1"
    assert got["moss"].startswith("0 2 10 2 100 2 1000 2") and len(got["moss"].split()) == 20_100


def test_grams_are_searched_before_they_are_counted(spark):
    docs = spark.createDataFrame([(1, "something inner thing"), (2, "thing inside thing inside"), (3, "moss")], "doc_id long, text string")
    got = _counted(ngram_index.local_index(docs, F.col("doc_id"), F.col("text"), stemmed=False, holding="thing in"))
    assert got == {("something inner", "1", 1), ("something inner thing", "1", 1), ("thing inside", "2", 2), ("thing inside thing", "2", 1), ("inside thing inside", "2", 1)}


def test_grams_of_single_rows_are_not_aggregated(spark):
    """What is shuffled for a count are ids, and the texts of those that repeat."""
    docs = spark.createDataFrame([(1, "red rose")], "doc_id long, text string")
    plan = ngram_index.local_index(docs, F.col("doc_id"), F.col("text"), stemmed=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "count(1) AS freq" not in plan


def test_page_tokens_of_repeated_pages(spark, tmp_path):
    pages = [(1, "u", "<p>moss moss</p>"), (1, "u", "<p>moss fern</p>"), (2, "v", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert _counted(queries.page_tokens(spark, str(tmp_path)).select("page_id", "term", "count")) == {(1, "moss", 3), (1, "fern", 1)}
    assert table(spark, str(tmp_path), "pages").count() == 3


def test_scores_by_document_are_those_by_term(spark):
    texts = [(i, f"moss rose {'fern ' * (i % 3)} {'abcdefghij'[i % 10] * 4} {'abcdefghijklmnopqrst'[i % 20] * 5}") for i in range(60)]
    counts = index.term_counts(spark.createDataFrame(texts, "doc_id long, text string"))
    columns = ["doc_id", "term", "count", "total", "df", "idf", "tf", "tfidf"]
    expected = _counted(index.tfidf(counts).select(columns))
    assert _counted(index.tfidf(counts, by_document=True).select(columns)) == expected and len(expected) > 200
    weights = index.term_weights(counts).cache()
    for most in (0, 1, 3, 10):  # none, some and all but the rarest are broadcast
        got = index.join_by_term(counts, weights, most).select("doc_id", "term", "count", "df", "idf").collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == {(e[0], e[1], e[2], e[4], e[5]) for e in expected}


def test_fixed_rounding_is_that_of_the_exact_value(spark):
    """Against Python's formatting: ties, near ties, large and negative values; most are not formatted."""
    values = [227.015, 0.5, 1.5, 2.5, 0.0000005, 0.0000015, 1e15 + 0.3, -0.125, -2.675, 3e9 + 0.015, 0.0, *(i / 997 for i in range(3000)), *(i / 2000 for i in range(3000))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for digits in (2, 6):
        got = [(r[0], r[1]) for r in df.where("v is not null and not isnan(v)").select("v", to_fixed(F.col("v"), digits)).collect()]
        assert [x for x in got if x[1] != float(f"{x[0]:.{digits}f}")] == [] and len(got) == len(values)
    assert "rint" in df.select(to_fixed(F.col("v"), 6))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert df.where("v is null").select(to_fixed(F.col("v"), 2)).first()[0] is None


def test_documents_are_upserted_as_their_postings_are(spark):
    def batch(rows):
        return spark.createDataFrame([(u, t, dt.datetime(2024, 1, day)) for u, t, day in rows], "url string, text string, ts timestamp")

    first = batch([("u1", "red rose", 1), ("u2", "moss", 3), ("u3", "fern fern palm", 1), ("u4", "", 1)])
    second = batch([("u1", "red moss moss", 2), ("u2", "moss fern", 2), ("u5", "palm", 1), ("u5", "palm rose", 2), ("u6", None, 2)])
    by_document = kvstore.upsert_documents(kvstore.upsert_documents(*map(incremental.batch_documents, (first, second))), incremental.batch_documents(second))
    got = explode_computed(by_document, "postings").select("_p.term", "url", "_p.tf", "_p.ts")
    expected = kvstore.upsert_postings(*map(incremental.batch_postings, (first, second))).select("term", "url", "tf", "ts")
    assert _counted(got) == _counted(expected) and got.count() == expected.count() == 9
