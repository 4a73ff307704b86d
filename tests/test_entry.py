import os

import pytest

import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "recommend_for_seeds" in queries and set(sql) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not there")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
