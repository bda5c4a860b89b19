"""The driver's entry point."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point


def test_registries():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert len(queries) >= 70 and set(oracles) <= set(queries)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_flagship(spark):
    out = entry_point.entry(spark)
    assert out.columns == ["doc_id", "score", "matched_terms", "total_terms", "total_words"] and out.count() == 20
