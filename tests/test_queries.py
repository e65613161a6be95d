"""Every query with a twin gives the twin's rows."""

import glob
import os

import duckdb
import pytest

from proseflow.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, twin, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert got.count() > 0
        return
    want = twin.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(r) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == rows
