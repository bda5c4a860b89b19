"""The shared folder of scratch tables."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from gleanery.llm import scratch


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_folder():
    assert scratch.scratch_dir(session("spark://x", "file:///shared")) == "file:///shared"
    own = scratch.scratch_dir(session("local[2]"))
    assert os.path.isdir(own) and scratch.scratch_dir(session("local[2]")) == own
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(session("spark://x"))
    os.rmdir(own)


def test_materialize_and_names(spark):
    df = scratch.materialize(spark.range(5), "five")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert scratch.fresh_name(df, "id") == "_id"


def test_tables_are_dropped(spark):
    with scratch.temporary(spark):
        inside, kept = scratch.materialize(spark.range(5), "inside"), scratch.materialize(spark.range(6), "kept", keep=True)
        paths = [df._scratch_path.removeprefix("file:") for df in (inside, kept)]
        assert all(map(os.path.isdir, paths))
    assert not os.path.exists(paths[0]) and kept.count() == 6
    scratch.drop(kept, spark.range(1))
    assert not os.path.exists(paths[1])


def test_small_tables_are_written_by_few_tasks(spark):
    table = scratch.materialize(spark.range(1000).repartition(40), "scan")
    out = scratch.materialize(table.repartition(64, "id"), "few")
    assert len(out.inputFiles()) <= spark.sparkContext.defaultParallelism and out.count() == 1000
