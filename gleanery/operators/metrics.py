"""Operational roll-ups: node metrics, health, progress rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollup(crawlers: DataFrame) -> DataFrame:
    """Totals over nodes and the mean crawl time per page (null without pages)."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("pages_processed", "bytes_downloaded", "terms_extracted", "targets_hit", "total_crawl_time")]
    total = crawlers.agg(*sums)
    return total.withColumn("avg_processing_time", F.try_divide(F.col("total_crawl_time").cast("double"), F.col("pages_processed").cast("double")))


def heap_totals(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum("heap_used").alias("heap_used"), F.sum("heap_total").alias("heap_total"))


def health(nodes: DataFrame) -> DataFrame:
    """Heap use of each node against its limit (crawlers 0.85, indexers 0.75), and the leak flag above 0.9."""
    used = F.try_divide(F.col("heap_used").cast("double"), F.col("heap_total").cast("double"))
    limit = F.when(F.col("kind") == "crawler", 0.85).otherwise(0.75)
    out = nodes.select("node", "kind", used.alias("usage"), (used < limit).alias("healthy"))
    return out.withColumn("possible_leak", ~F.col("healthy") & (F.col("usage") > 0.9))


def rates(samples: DataFrame) -> DataFrame:
    """Pages per second and minute between the samples (``node``, ``at`` seconds, ``pages``) of each node."""
    order = Window.partitionBy("node").orderBy("at")
    step = samples.withColumn("d_pages", F.col("pages") - F.lag("pages").over(order)).withColumn("d_at", F.col("at") - F.lag("at").over(order)).where("d_at is not null")
    per_second = F.try_divide(F.col("d_pages").cast("double"), F.col("d_at").cast("double"))
    return step.select("node", "at", per_second.alias("per_second"), (per_second * 60).alias("per_minute"))


def recent(times: DataFrame, shown: int = 5) -> DataFrame:
    """The last ``shown`` batch times (``node``, ``seq``, ``ms``) of each node."""
    last = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("seq")))
    return times.withColumn("rank", last).where(F.col("rank") <= shown)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates(["ip", "port"])
