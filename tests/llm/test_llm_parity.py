"""The queries that SQL can express against their DuckDB twins; the others run on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from gleanery.llm import queries as llm

FOLDER = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = llm.queries()[name](spark, FOLDER)
    assert df.columns == columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, name):
    assert llm.queries()[name](spark, FOLDER).count() > 0
