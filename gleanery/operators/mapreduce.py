"""Keyed map -> shuffle -> reduce on DataFrames.

Built-in expressions are the fast way: ``map_reduce`` explodes (key, value) structs and aggregates them with
Catalyst's partial aggregation. ``map_reduce_functions`` takes opaque Python closures, batch-wise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_reduce(df: DataFrame, emissions: Column, **aggregates: Column) -> DataFrame:
    """``emissions``: an array of (key, value) structs per row; ``aggregates`` see columns ``key`` and ``value``."""
    emitted = df.select(F.explode(emissions).alias("e")).select("e.*")
    return emitted.groupBy("key").agg(*(c.alias(n) for n, c in aggregates.items()))


def batch_slice(df: DataFrame, node: Column, key: str, batch_index: int, batch_size: int = 10) -> DataFrame:
    """The ``batch_index``-th run of ``batch_size`` keys of each node, in key order."""
    position = F.row_number().over(Window.partitionBy(node).orderBy(key))
    first = batch_index * batch_size
    return df.withColumn("_position", position).where(F.col("_position").between(first + 1, first + batch_size)).drop("_position")


def rejected_rows(df: DataFrame, mapper: Callable[[Any, Any], Iterable[tuple[str, Any]]], key_col: str = "key", value_col: str = "value") -> DataFrame:
    """``key`` and ``error`` of the rows that ``map_reduce_functions`` leaves out as their mapper fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failed: list[tuple[str, str]] = []
            for key, value in zip(batch["k"], batch["v"], strict=True):
                try:
                    list(mapper(key, value))
                except Exception as error:  # noqa: BLE001  the contract: whatever a mapper raises
                    failed.append((key, type(error).__name__))
            yield pd.DataFrame(failed, columns=["key", "error"])

    return df.select(F.col(key_col).alias("k"), F.col(value_col).alias("v")).mapInPandas(run, "key string, error string")


def map_reduce_functions(
    df: DataFrame,
    mapper: Callable[[Any, Any], Iterable[tuple[str, Any]]],
    reducer: Callable[[str, list], Any],
    value_type: T.DataType,
    result_type: T.DataType,
    key_col: str = "key",
    value_col: str = "value",
) -> DataFrame:
    """Python closures: ``mapper(key, value)`` gives (key, value) pairs, ``reducer(key, values)`` a result.

    A mapper's exception skips its row (``rejected_rows`` lists them) and a reducer's its key. A key's values meet in one task: use
    ``map_reduce`` where an aggregate can do it.
    """
    emitted = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value_type)])
    result = T.StructType([T.StructField("key", T.StringType()), T.StructField("result", result_type)])

    def run_map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, Any]] = []
            for key, value in zip(batch["k"], batch["v"], strict=True):
                try:
                    rows += list(mapper(key, value))
                except Exception:  # noqa: BLE001, S112  the contract: bad rows are left out
                    continue
            yield pd.DataFrame(rows, columns=["key", "value"])

    def run_reduce(group: pd.DataFrame) -> pd.DataFrame:
        key = group["key"].iloc[0]
        try:
            return pd.DataFrame([(key, reducer(key, group["value"].tolist()))], columns=["key", "result"])
        except Exception:  # noqa: BLE001  the contract: a failing key is left out
            return pd.DataFrame([], columns=["key", "result"])

    mapped = df.select(F.col(key_col).alias("k"), F.col(value_col).alias("v")).mapInPandas(run_map, emitted)
    return mapped.groupBy("key").applyInPandas(run_reduce, result)


def iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, max_rounds: int | None = None) -> DataFrame:
    """``step`` applied until it changes nothing; each round is a table under ``folder`` (on a cluster: a shared one).

    Rows have to be distinct. With ``max_rounds``, a table that still changes after so many raises an error.
    """
    spark, path = start.sparkSession, f"{folder.rstrip('/')}/iterate-{uuid.uuid4().hex}"

    def save(rows: DataFrame, n: int) -> DataFrame:
        rows.write.parquet(f"{path}/round={n}")
        return spark.read.schema(rows.schema).parquet(f"{path}/round={n}")

    table, n = save(start, 0), 0
    while True:
        n += 1
        before, table = table, save(step(table), n)
        if table.exceptAll(before).isEmpty() and before.count() == table.count():
            return table
        if n == max_rounds:
            raise RuntimeError(f"the table still changes after {max_rounds} rounds")
