"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def _entry():
    import __spark_entry__

    return __spark_entry__


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(_entry().oracle_sql()))
def test_same_rows(spark, duck, name):
    got = _entry().queries()[name](spark, SF)
    cols = sorted(got.columns)
    cur = duck.execute(_entry().oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in cols) for r in got.collect()) == want


def test_every_query_has_a_name_and_entry_runs(spark):
    assert _entry().entry(spark).count() > 0
    assert set(_entry().oracle_sql()) <= set(_entry().queries())
