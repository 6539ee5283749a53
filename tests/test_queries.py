"""Registered queries against their oracle SQL in DuckDB."""

import glob
import math
import os

import pytest

from wearline.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in t[columns].itertuples(index=False)) for t in (got, want)]
    assert rows[0] == rows[1]


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isfinite(len(entry.queries()))
