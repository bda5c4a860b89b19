"""Stores, caches, named functions, batches, resumed crawls and the published index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.functions.registry import Functions
from gleanery.operators import kvstore, mapreduce, search
from gleanery.operators.cache import QueryCache
from gleanery.operators.lists import in_blocks
from gleanery.operators.memstore import MemStore
from gleanery.operators.stored import StoredIndex, publish_index
from gleanery.sources import tables
from gleanery.streaming import crawl


def test_mem_store(spark):
    store = MemStore()
    key = store.put(spark.range(3))
    assert store.keys() == [key] and store.get(key).count() == 3
    store.put(spark.range(5), key)
    assert store.get(key).count() == 5 and store.get(key).is_cached
    store.put(spark.range(1), "x", "group")
    assert store.keys("group") == ["x"] and store.delete("x", "group").count() == 1
    with pytest.raises(KeyError):
        store.get("x", "group")
    store.clear()
    assert store.keys() == []


def test_query_cache():
    now = [0.0]
    held = QueryCache(max_size=2, ttl=10, clock=lambda: now[0])
    held.set("a", 1), held.set("b", 2)
    assert held.get("a") == 1
    held.set("c", 3)
    assert held.get("b") is None and held.get("a") == 1 and len(held) == 2
    now[0] = 11
    assert held.get("a") is None and held.through("a", lambda: 7) == 7 and held.get("a") == 7
    held.clear()
    assert len(held) == 0


def test_named_functions():
    known = Functions()
    known.put(len, "size", "g")
    assert known.get("size", "g")("abc") == 3 and known.names("g") == ["size"] and known.names() == []
    known.delete("size", "g")
    with pytest.raises(KeyError):
        known.get("size", "g")
    with pytest.raises(ValueError, match="callable"):
        known.put(None, "x")


def test_groups(spark):
    log = spark.createDataFrame([(1, "add", "g", "a", 1), (2, "del", "g", None, None), (3, "add", "g", "b", 2), (4, "add", "h", "c", 3)], "seq long, op string, gid string, ip string, port int")
    assert [tuple(r) for r in kvstore.group(log, "g").collect()] == [("b", 2)]
    assert kvstore.group(log, "none").count() == 0


def test_batches_stop_resume_and_leave_out_what_is_not_committed(spark, tmp_path):
    path = str(tmp_path / "batches")
    batches = {b: spark.createDataFrame([(b * 10 + i,) for i in range(2)], "v long") for b in range(3)}
    assert tables.committed(spark, path) is None
    assert tables.run_batches(spark, batches, lambda rows: rows, path, most=2) == [0, 1]
    tables.append_batch(batches[2], path, 9)
    assert sorted(r.v for r in tables.read_batches(spark, path).collect()) == [0, 1, 10, 11]
    assert tables.run_batches(spark, batches, lambda rows: rows, path) == [2]
    tables.commit_batches(spark, path, [2])
    assert tables.committed(spark, path) == [0, 1, 2]


def test_a_deep_crawl_goes_to_its_end_and_resumes(spark, tmp_path):
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(60)], "src string, dst string")
    seeds = spark.createDataFrame([("u0",), (None,)], "url string")
    with pytest.raises(RuntimeError):
        crawl.crawl(edges, seeds, str(tmp_path), max_rounds=3, name="deep")
    found = crawl.crawl(edges, seeds.limit(0), str(tmp_path), name="deep")
    assert {(r.url, r.depth) for r in found.collect()} == {(f"u{i}", i) for i in range(61)}


def test_iterate(spark, tmp_path):
    start = spark.createDataFrame([(1, 8), (2, 3)], "k int, v int")
    halve = lambda t: t.select("k", F.floor(F.col("v") / 2).cast("int").alias("v"))
    assert {tuple(r) for r in mapreduce.iterate(start, halve, str(tmp_path)).collect()} == {(1, 0), (2, 0)}
    with pytest.raises(RuntimeError):
        mapreduce.iterate(start, halve, str(tmp_path), max_rounds=2)


def test_published_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red rose garden rose"), (2, "red house"), (3, "garden wall house moss"), (4, ""), (5, None)], "doc_id long, text string")
    path = str(tmp_path / "index")
    publish_index(docs, path)
    stored = StoredIndex(spark, path)
    assert [r["term"] for r in stored.get_terms(["wall", "nothing", "rose"])] == ["wall", "rose"]
    assert [r["doc_id"] for r in stored.get_documents([3, 99, 1])] == [3, 1] and stored.get_terms([]) == [] and stored.get_documents([]) == []
    assert {r["doc_id"]: (r["matched_terms"], r["total_words"]) for r in stored.search("red rose").collect()} == {1: (2, 4), 2: (1, 2)}
    assert {r["doc_id"] for r in stored.similar([2]).collect()} == {1, 3}
    plan = stored.postings(["rose"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60]
    assert search.similar_to(stored.documents([99]), stored.postings(["rose"])).count() == 0


def test_long_lists_are_dealt_over_blocks(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 1), ("cold", 0)], "k string, v long")
    got = {(r.k, r.block): r["items"] for r in in_blocks(rows, "k", F.col("v"), "items", size=20).collect()}
    assert got.pop(("cold", 0)) == [0, 1]
    assert len(got) == 5 and sorted(v for items in got.values() for v in items) == list(range(100))
    assert all(items == sorted(items) for items in got.values())
