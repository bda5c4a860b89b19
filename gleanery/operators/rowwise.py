"""Counting inside rows: what a document's own row decides is not shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are dealt over so many hash values; those of repeated keys are broadcast, so this bounds the broadcast.
KEY_HASHES = 1 << 20


def by_repetition(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in no other row, the rest): every row is in one of them, and rows of equal keys are in the same.

    Only the keys are shuffled for it. The rest also holds a few rows that share a hash value with a repeated key.
    """

    def spot(name: Column | str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(KEY_HASHES))

    repeated = rows.select(F.col(key).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1")
    spots = F.broadcast(repeated.select(spot("_k").alias("_spot")).distinct())
    placed = rows.withColumn("_spot", spot(key))
    return placed.join(spots, "_spot", "left_anti").drop("_spot"), placed.join(spots, "_spot", "left_semi").drop("_spot")


def count_arrays(rows: DataFrame, items: str, name: str, count: str) -> DataFrame:
    """``items`` becomes the array of its distinct elements, as ``name``, with their ``count`` in that row; other columns stay.

    The array is sorted, and an element counts up to the start of the next one: n log n in one row, no shuffle, no aggregation.
    """
    others = [c for c in rows.columns if c != items]
    held = rows.select(*others, F.sort_array(items).alias("_s"))
    # each step names the arrays before it more than once, so that they are computed once a row and not once an element
    new = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | ~F.get("_s", i).eqNullSafe(F.get("_s", i - 1)))
    starts = F.when(F.size("_s") > 0, new)
    found = held.select(*others, "_s", starts.alias("_at"))
    pairs = F.transform("_at", lambda at, k: F.struct(F.get("_s", at).alias(name), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - at).cast("bigint").alias(count)))
    return found.select(*others, pairs.alias(items))


def explode_counts(rows: DataFrame, items: str, name: str, count: str) -> DataFrame:
    """A row for each distinct element of ``items``, see ``count_arrays``."""
    others = [c for c in rows.columns if c != items]
    return explode_computed(count_arrays(rows, items, name, count), items).select(*others, f"_p.{name}", f"_p.{count}")


def explode_computed(rows: DataFrame, items: str) -> DataFrame:
    """``items`` becomes a row for each element, ``_p``, none of which is null.

    By ``explode_outer``: for ``explode``, Spark infers a filter by the array's size, whose pushing down would compute arrays inside the lambdas that read them.
    """
    return rows.select(*(c for c in rows.columns if c != items), F.explode_outer(items).alias("_p")).where("_p is not null")


def count_by_key(rows: DataFrame, key: str, prepare: Callable[[DataFrame], DataFrame], items: str, name: str, count: str) -> DataFrame:
    """``explode_counts`` of ``prepare(rows)``; the rows of a repeated key are added up (by all columns but ``items``)."""
    single, several = by_repetition(rows, key)
    parts = explode_counts(prepare(several), items, name, count)
    summed = parts.groupBy(*(c for c in parts.columns if c != count)).agg(F.sum(count).alias(count))
    return explode_counts(prepare(single), items, name, count).unionByName(summed)
