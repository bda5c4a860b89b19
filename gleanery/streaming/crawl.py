"""Crawling as rounds over tables of pages: a frontier, a visited set, anti-joins between them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.html import is_indexable, is_target


def frontier_round(frontier: DataFrame, visited: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of the frontier's pages that are neither visited nor in the frontier (``url``, distinct)."""
    found = edges.join(frontier.select("url"), edges["src"] == frontier["url"]).select(edges["dst"].alias("url")).distinct()
    return found.join(visited, "url", "left_anti").join(frontier.select("url"), "url", "left_anti")


def crawl(edges: DataFrame, seeds: DataFrame, folder: str, max_rounds: int | None = None, name: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``url``, ``depth`` of every url reachable over ``edges`` (src, dst) from the seeds, in rounds.

    Each round is a table under ``folder`` (on a cluster: a shared one), so rounds survive lost executors and lineage stays
    short. A crawl with a ``name`` that has stopped is taken up after its last complete round; without one it is new. Rounds go on
    until the frontier is empty; with ``max_rounds``, a frontier left after so many raises an error. With ``targets`` (``url``),
    only links of those pages are followed.
    """
    spark = edges.sparkSession
    if targets is not None:
        edges = edges.join(targets.select(F.col("url").alias("src")), "src", "left_semi")
    path = f"{folder.rstrip('/')}/crawl-{name or uuid.uuid4().hex}"

    def read(depth: int) -> DataFrame:
        return spark.read.schema("url string, depth int").parquet(f"{path}/round={depth}")

    def save(rows: DataFrame, depth: int) -> DataFrame:
        rows.selectExpr("url", f"{depth} as depth").write.mode("overwrite").parquet(f"{path}/round={depth}")
        return read(depth)

    depth = _complete_rounds(spark, path) - 1
    if depth < 0:
        depth, frontier = 0, save(seeds.select("url").where("url is not null").distinct(), 0)
        visited = frontier
    else:
        frontier = read(depth)
        visited = reduce(DataFrame.unionByName, map(read, range(depth + 1)))
    while not frontier.isEmpty():
        if depth == max_rounds:
            raise RuntimeError(f"the crawl has pages left after {max_rounds} rounds")
        depth += 1
        frontier = save(frontier_round(frontier, visited.select("url"), edges), depth)
        visited = visited.unionByName(frontier)
    return visited


def _complete_rounds(spark: SparkSession, path: str) -> int:
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(paths(f"{path}/round={n}/_SUCCESS")):
        n += 1
    return n


def crawled_targets(visited: DataFrame, records: DataFrame) -> DataFrame:
    """The crawl's pages that pass the gate of the index: ``url``, ``depth``, and whether it is of a target class and indexed.

    ``records`` holds ``url``, ``hierarchy`` and ``binomial_name`` of the pages read; pages without a record are no targets.
    """
    gates = records.select("url", is_target(F.col("hierarchy")).alias("target"), is_indexable(F.col("hierarchy"), F.col("binomial_name")).alias("indexed"))
    return visited.join(gates, "url", "left").select("url", "depth", F.coalesce("target", F.lit(False)).alias("is_target"), F.coalesce("indexed", F.lit(False)).alias("is_indexed"))


def enqueue(links: DataFrame, queue: DataFrame, crawled: DataFrame) -> DataFrame:
    """Distinct new links: in neither the queue nor the crawled set."""
    return links.select("url").distinct().join(queue.select("url"), "url", "left_anti").join(crawled.select("url"), "url", "left_anti")
