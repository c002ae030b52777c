"""Every query of the catalog against its DuckDB SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    assert all(near(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
