"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quernel.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    expected = con.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    assert rows == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall()))
