"""Lists of a key's elements in rows of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that a row holds at most, or close to it: longer lists are dealt over blocks by a hash.
BLOCK = 10_000


def in_blocks(rows: DataFrame, key: str, element: Column, name: str, size: int = BLOCK) -> DataFrame:
    """``key``, ``block`` and the sorted list ``name`` of distinct elements. All of a key are in block 0 unless they are more than ``size``.

    Only the keys with more are counted into the plan, and blocks are shuffled apart, so no key makes a hot task or a huge row.
    """
    elements = rows.select(key, element.alias(name))
    large = elements.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    blocks = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1))
    placed = elements.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64(name), blocks).cast("int"))
    return placed.groupBy(key, "block").agg(F.array_sort(F.collect_list(name)).alias(name))
