"""Shared-folder tables that cut lineage, and small helpers all operators use."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder serves in local mode; a cluster must name one.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"gleanery-{application}-")


#: Paths of the tables that the innermost ``temporary`` block drops.
_BLOCKS: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Drops the tables written in the block when it ends, but for those that ``materialize`` is told to keep."""
    _BLOCKS.append([])
    try:
        yield
    finally:
        for path in _BLOCKS.pop():
            _delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``tables``: once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, keep: bool = False, growth: int = 1) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a scan of it.

    The table outlives lost executors, cuts the lineage and has real statistics for AQE.
    What comes of little input is written by few tasks: each file costs its store requests (a local store
    even starts a process for its permissions), and many shuffle partitions of a small table are all cost.
    ``growth`` says how many rows the plan makes of each that it reads.
    """
    spark = df.sparkSession
    folder = f"{scratch_dir(spark).rstrip('/')}/gleanery-{uuid.uuid4().hex}"
    df.coalesce(_writers(df, growth)).write.option("compression", "zstd").parquet(f"{folder}/{name}")
    if _BLOCKS and not keep:
        _BLOCKS[-1].append(folder)
    table = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    table._scratch_path = folder
    return table


#: Bytes of the tables that a plan reads for each task that writes its result; never fewer tasks than cores.
_WRITER_BYTES = 2 << 20


def _writers(df: DataFrame, growth: int) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 30, growth * size // _WRITER_BYTES + 1))


def lean(step: Callable) -> Callable:
    """``step`` over small Arrow batches; its worker gives its free memory back when the task ends.

    Workers live through many tasks, and what one stage has touched would stay with them in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(_cut_small(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(_c_library(), "malloc_trim", None)) is not None:
                trim(0)

    return run


#: Rows and bytes of the batches that a step sees; a single longer row is a batch of its own.
_STEP_ROWS, _STEP_BYTES = 2048, 4 << 20


def _cut_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, min(_STEP_ROWS, batch.num_rows * _STEP_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@functools.cache
def _c_library():
    return ctypes.CDLL(None)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, so extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
