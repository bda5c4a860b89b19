"""Index, search, store, n-grams, crawl, streaming and metrics."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gleanery import fixtures as fx
from gleanery.operators import index, kvstore, metrics, ngram_index, search
from gleanery.sources import tables
from gleanery.streaming import crawl, incremental

DOCS = [(1, "red rose rose"), (2, "red moss"), (3, "green moss moss fern"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def scored(spark):
    return index.tfidf(index.term_counts(spark.createDataFrame(DOCS, "doc_id long, text string"))).cache()


@pytest.fixture(scope="module")
def postings(scored):
    return index.postings(scored).withColumn("score", F.col("tfidf")).cache()


def test_weights(scored):
    got = {(r.doc_id, r.term): r for r in scored.collect()}
    assert math.isclose(got[(1, "rose")].tfidf, 2 / 3 * math.log(3)) and got[(1, "red")].df == 2 and len(got) == 7
    assert {r.doc_id for r in got.values()} == {1, 2, 3}


@pytest.mark.parametrize(("denominator", "total"), [("terms", 2), ("words", 3), ("distinct", 1)])
def test_denominators(spark, denominator, total):
    docs = spark.createDataFrame([(1, "rose rose x1")], "doc_id long, text string")
    assert index.term_counts(docs, denominator=denominator).first().total == total


def test_objects(scored):
    terms = {r.term: r for r in index.term_objects(scored, 1).collect()}
    assert terms["moss"].postings[0].doc_id == 2 and terms["rose"].shard == "ro" and len(terms["red"].postings) == 1
    docs = {r.doc_id: r for r in index.doc_objects(scored, 1).collect()}
    assert docs[1].terms[0].term == "rose" and docs[1].total_words == 3
    norms = {r.doc_id: r.doc_norm for r in index.doc_norms(scored).collect()}
    assert math.isclose(norms[1], math.hypot(2 / 3 * math.log(3), 1 / 3 * math.log(1.5)), abs_tol=1e-6)


def test_global_terms_admission(spark):
    importance = spark.createDataFrame([("a", 0.01), ("b", 0.5), ("c", 0.02), ("d", 0.3)], "term string, importance double")
    assert [r.term for r in index.global_terms(importance, limit=2).collect()] == ["b", "d"]
    assert {r.term for r in index.global_terms(importance, limit=3).collect()} == {"b", "d", "c"}


def test_search(spark, postings):
    documents = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "doc_id long, title string")
    plain = search.search(postings, documents, "moss").orderBy(F.desc("score"), "doc_id").collect()
    assert [r.doc_id for r in plain] == [2, 3] and plain[0].title == "two" and plain[0].total_terms == 1
    both = {r.doc_id: r for r in search.search(postings, documents, '"red rose"').collect()}
    idf = {"red": math.log(1.5), "rose": math.log(3)}
    expected = (1 / 3 * idf["red"] + 2 / 3 * idf["rose"]) * 1.5 * 1.5 * 1.5
    assert math.isclose(both[1].score, expected, abs_tol=1e-5) and both[1].matched_terms == 2
    assert search.search(postings, documents, "of a").count() == 0
    assert [r.doc_id for r in search.search(postings, documents.where("doc_id <> 2"), "moss").collect()] == [3]


def test_similar_and_lookups(scored, postings):
    vectors = index.doc_vectors(scored)
    assert {r.doc_id for r in search.similar_to(vectors.where("doc_id = 2"), postings).collect()} == {1, 3}
    assert search.similar_to(vectors.where("doc_id = 99"), postings).count() == 0
    assert [r.term for r in search.document_details(vectors.where("doc_id = 1"), 1).collect()] == ["rose"]
    weak = postings.withColumn("score", F.lit(0.0)).withColumn("idf", F.lit(0.0))
    assert search.repair_min_idf(weak).agg(F.min("idf"), F.min("score")).first()[:] == (0.001, 1e-6)


def test_boosted_scores(spark):
    records = spark.createDataFrame(fx.SPECIES, tables.RECORD)
    got = {(r.url, r.term): r for r in index.boosted_scores(records).collect()}
    assert got[("/wiki/Rose", "rosa")].taxonomy_level == "order" and got[("/wiki/Rose", "rosa")].binomial_boost == 4.0
    assert math.isclose(got[("/wiki/Rose", "plant")].score, 3 / 10 * 5.0 * 1.0 * 3.0)
    assert math.isclose(got[("/wiki/Fern", "plantae")].score, 1 / 4 * 5.0 * 3.0) and not got[("/wiki/Fern", "fern")].is_binomial


def test_store(spark):
    log = spark.createDataFrame(fx.OPS, fx.OPS_SCHEMA)
    entries = kvstore.state(log)
    assert {(r.key, r.value) for r in entries.where("gid = 'users'").collect()} == {("ann", "three"), ("cy", "four")}
    assert {r.key for r in kvstore.list_keys(entries, "files").collect()} == {"a.b", "a_b"}
    assert kvstore.get(entries, "users", "bob").count() == 0
    assert {(r.field, tuple(r["values"])) for r in kvstore.append(log).collect()} == {("points", ("10", "20")), ("name", ("n",))}
    keyed = kvstore.default_key(spark.createDataFrame([(None, "v"), ("k", "v")], fx.KV))
    assert sorted(len(r.key) for r in keyed.collect()) == [1, 64]


def test_upsert_is_idempotent(spark):
    old, new = (spark.createDataFrame(rows, fx.POSTINGS_SCHEMA) for rows in (fx.POSTINGS_OLD, fx.POSTINGS_NEW))
    once = kvstore.upsert_postings(old, new)
    twice = kvstore.upsert_postings(once, new)
    assert ngram_index.same(once, twice) and {(r.term, r.df) for r in once.collect()} == {("ant", 3), ("bee", 1), ("cat", 1)}


def test_ngram_text_formats(spark):
    lines = spark.createDataFrame([("red rose | 2 | u1",), ("bad line",), ("x | y | u",), ("moss | 10 | u2",)], "line string")
    rows, rejected = ngram_index.parse_local(lines)
    assert {tuple(r) for r in rows.collect()} == {("red rose", "u1", 2), ("moss", "u2", 10)} and rejected.count() == 2
    postings = spark.createDataFrame([("a", "u1", 9), ("a", "u2", 10), ("b c", "u1", 1)], tables.LOCAL_INDEX)
    text = ngram_index.to_lines(ngram_index.global_index(postings))
    assert {r.line for r in text.collect()} == {"a | u2 10 u1 9", "b c | u1 1"}
    back, bad = ngram_index.parse_global(text.unionByName(spark.createDataFrame([("odd | u1",)], "line string")))
    assert ngram_index.same(back, postings) and [r.line for r in bad.collect()] == ["odd | u1"]
    merged = ngram_index.merge(postings, spark.createDataFrame([("a", "u1", 1)], tables.LOCAL_INDEX))
    assert {tuple(r) for r in merged.collect()} == {("a", "u1", 1), ("a", "u2", 10), ("b c", "u1", 1)}
    assert not ngram_index.same(merged, postings) and ngram_index.same(merged, postings, 70)


def test_sources(spark, tmp_path, scored):
    article = '{"url":"u","binomial_name":"b","article_words":["x"]}'
    wrapped = '{"type":"string","value":"{\\"url\\":\\"w\\"}"}'
    raw = spark.createDataFrame([(article,), (wrapped,), ("{}",), ("junk",), (None,)], "raw string")
    assert sorted(r.url for r in tables.decode_articles(raw).collect()) == ["u", "w"]
    path = str(tmp_path / "index")
    tables.publish(index.term_objects(scored), path)
    read = spark.read.parquet(path)
    assert read.count() == 5 and "PartitionFilters: [isnotnull(shard" in read.where("shard = 'ro'")._jdf.queryExecution().executedPlan().toString()
    for batch in (0, 1, 1):
        tables.append_batch(spark.range(batch + 1), str(tmp_path / "batches"), batch)
    assert spark.read.parquet(str(tmp_path / "batches")).count() == 3
    tables.write_lines(spark.createDataFrame([("b",), ("a",)], "line string"), str(tmp_path / "lines"))
    assert [r.line for r in tables.read_lines(spark, str(tmp_path / "lines")).collect()] == ["a", "b"]
    assert tables.redistribute(spark.range(10), "id", 3).rdd.getNumPartitions() == 3


def test_crawl(spark, tmp_path):
    edges = spark.createDataFrame(fx.EDGES, "src string, dst string")
    got = {r.url: r.depth for r in crawl.crawl(edges, spark.createDataFrame([("a",), ("a",), (None,)], "url string"), str(tmp_path)).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "g": 3}


def test_stream_equals_batch(spark, tmp_path):
    def at(day):
        return dt.datetime(2024, 1, day)

    batches = [[("u1", "red rose", at(1)), ("u2", "moss", at(1))], [("u1", "green rose", at(2)), ("u3", "red fern", at(2))]]
    schema = "url string, text string, ts timestamp"
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.index_stream(stream, path, checkpoint).awaitTermination()
    newest = {r[0]: r for rows in batches for r in rows}
    expected = {(t, u, 0.5 if len(text.split()) == 2 else 1.0) for u, text, _ in newest.values() for t in text.split()}
    assert {(r.term, r.url, r.tf) for r in incremental.current(spark, path).collect()} == expected
    incremental.merge_batch(spark.createDataFrame(batches[1], schema), 1, path)
    assert incremental.current(spark, path).count() == len(expected)


def test_event_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 5), "click") for d in (1, 1, 2)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "events"))
    stream = incremental.event_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "events")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]


def test_metrics(spark):
    total = metrics.rollup(spark.createDataFrame(fx.CRAWLERS, fx.CRAWLERS_SCHEMA)).first()
    assert total.pages_processed == 588 and total.targets_hit == 77
    empty = metrics.rollup(spark.createDataFrame([(1, 0, 0, None, 0, 0)], fx.CRAWLERS_SCHEMA)).first()
    assert empty.avg_processing_time is None and empty.bytes_downloaded == 0
    state = {r.node: (r.healthy, r.possible_leak) for r in metrics.health(spark.createDataFrame(fx.HEAPS, fx.HEAPS_SCHEMA)).collect()}
    assert state == {"n1": (True, False), "n2": (False, False), "n3": (False, False), "n4": (False, True), "n5": (None, None)}
    assert metrics.heap_totals(spark.createDataFrame(fx.HEAPS, fx.HEAPS_SCHEMA)).first().heap_used == 323
    times = spark.createDataFrame([("n", i, i * 10) for i in range(20)], "node string, seq long, ms long")
    assert sorted(r.seq for r in metrics.recent(times).collect()) == [15, 16, 17, 18, 19]
    assert metrics.distinct_nodes(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "ip string, port int")).count() == 2


def test_a_crawl_goes_on_to_the_end_or_says_so(spark, tmp_path):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(55)], "src string, dst string").coalesce(1).cache()
    seeds = spark.createDataFrame([("0",)], "url string")
    assert crawl.crawl(edges, seeds, str(tmp_path)).agg(F.max("depth")).first()[0] == 55
    with pytest.raises(RuntimeError):
        crawl.crawl(edges, seeds, str(tmp_path), max_rounds=2)
