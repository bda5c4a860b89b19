"""Known results of the map-reduce catalogue."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import fixtures as fx
from gleanery.operators import mapreduce
from gleanery.plans import catalogue as c


def run(spark, f, rows):
    return {tuple(r)[0]: tuple(r)[1] for r in f(spark.createDataFrame(rows, fx.KV)).collect()}


# Expected results.
CASES = [
    (c.max_by_year, fx.NCDC, {"1950": 22, "1949": 111}),
    (c.max_by_month, fx.MONTHS, {"1950-05": 22, "1950-06": 35, "1949-03": 111, "1949-07": 128}),
    (c.mean_price, fx.QUOTES, {"AAPL": 131.25, "MSFT": 227.01, "GOOG": 89.05}),
    (c.status_counts, fx.WEBLOG, {"200": 4, "404": 1, "401": 1, "500": 1, "301": 1}),
    (c.revenue_by_category, fx.SALES, {"Electronics": 1449.95, "Clothing": 124.96, "Books": 61.97}),
    (c.mean_word_length, fx.WORD_LENGTHS, {"doca": 5.5, "docb": 7.0, "docc": 5.14}),
    (c.char_frequency, fx.CHARACTERS, dict(h=2, e=7, l=4, o=3, w=1, r=4, d=2, m=2, a=4, p=2, u=2, c=4, t=4, s=1, n=2, i=1, g=1, x=1)),
    (c.word_count_clean, fx.FOXES, {"the": 3, "quick": 3, "brown": 2, "fox": 3, "jumps": 1, "over": 1, "lazy": 2, "dog": 2, "a": 1, "is": 3, "and": 1, "every": 1, "different": 1, "but": 1, "that": 1, "one": 1, "was": 1}),
]


@pytest.mark.parametrize(("workload", "rows", "expected"), CASES, ids=[f.__name__ for f, _, _ in CASES])
def test_known_results(spark, workload, rows, expected):
    assert run(spark, workload, rows) == expected


def test_word_count_raw(spark):
    got = run(spark, c.word_count_raw, fx.LINES)
    assert len(got) == 21 and got["was"] == 10 and got["it"] == 9 and got["It"] == 1 and got["times,"] == 2


def test_tfidf_log10(spark):
    got = {(r.word, r.doc): r.tfidf for r in c.tfidf_log10(spark.createDataFrame(fx.LEARNING, fx.KV)).collect()}
    assert got[("is", "doc1")] == 0.12 and got[("deep", "doc2")] == 0.04 and got[("deep", "doc3")] == 0.03 and got[("learning", "doc1")] == 0.0 and len({w for w, _ in got}) == 10


def test_matches_inverted_index_and_reverse_links(spark):
    assert c.matching_docs(spark.createDataFrame(fx.MAIL, fx.KV)).first().docs == "doc1,doc6,doc8"
    index = run(spark, lambda docs: c.inverted_index(docs).drop("block"), fx.RINDEX)
    assert len(index) == 25 and index["quick"] == ["doc101", "doc102", "doc105"] and index["are"] == ["doc102", "doc103"]
    links = {(r.sink, r.source): r.score for r in c.reverse_links(spark.createDataFrame(fx.HOSTS, fx.KV)).collect()}
    assert links[("www.news.com", "www.blog.com")] == 0.12 and links[("www.ingredients.com", "www.cooking.com")] == 0.42


def test_opaque_functions(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", None)], fx.KV)
    out = mapreduce.map_reduce_functions(df, lambda k, v: [(w, 1) for w in v.split()], lambda k, vs: sum(vs), T.LongType(), T.LongType())
    assert {r.key: r.result for r in out.collect()} == {"x": 2, "y": 2}
    failing = mapreduce.map_reduce_functions(df, lambda k, v: [(w, 1) for w in v.split()], lambda k, vs: 1 // (k != "x"), T.LongType(), T.LongType())
    assert {r.key for r in failing.collect()} == {"y"}


def test_expression_map_reduce_and_slices(spark):
    df = spark.range(25).select(F.format_string("k%02d", "id").alias("key"), (F.col("id") % 2).alias("node"))
    pairs = F.array(F.struct(F.col("node").alias("key"), F.lit(1).alias("value")))
    assert {r.key: r.n for r in mapreduce.map_reduce(df, pairs, n=F.sum("value")).collect()} == {0: 13, 1: 12}
    second = mapreduce.batch_slice(df, F.col("node"), "key", 1)
    assert sorted(r.key for r in second.collect()) == ["k20", "k21", "k22", "k23", "k24"]
