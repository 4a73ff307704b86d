"""Every query that SQL can express gives DuckDB's rows on the smallest test tables."""

import math
import os

import duckdb
import pytest

from cohortmart.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple(plain(r[c]) for c in sorted(names))
    got = sorted((key(r.asDict()) for r in df.collect()), key=repr)
    assert got == sorted((key(r) for r in want), key=repr)
