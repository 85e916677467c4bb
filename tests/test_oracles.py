"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from foliospark.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return (type(value).__name__, str(value))
    if isinstance(value, (list, tuple)):
        return ("list", str([plain(x) for x in value]))
    return ("number", repr(round(float(value), 6) + 0.0))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.select(*columns).collect())
    told = tables.sql(ORACLES[name])
    assert sorted(told.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tuple(map(plain, r)) for r in tables.sql(f"select {names} from ({ORACLES[name]}) q").fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
