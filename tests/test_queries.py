"""Every registered query against its SQL, on the driver's smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from rillwork.plans import registry

DIR = os.environ.get("RILLWORK_TEST_DIR", "/root/testdata/sf0.001")
OWN, SQL = registry.queries(), registry.oracle_sql()
#: Queries that have no rows on the smallest tables, whose grid has four rows of cells.
EMPTY_HERE = {"r10_south_crest", "r19_roi_ring", "r20_sub_terrain", "io14_tin"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    return norm(float(x)) if not isinstance(x, (dict, bytes, bytearray)) and hasattr(x, "__float__") else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck):
    df = OWN[name](spark, DIR)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(norm(x) for x in r) for r in want.fetchall())
    assert mine == theirs
    assert mine or name in EMPTY_HERE


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_query_without_sql_runs(name, spark):
    assert OWN[name](spark, DIR).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
