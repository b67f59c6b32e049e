"""Every core query runs on the smallest tables and equals its SQL."""

import glob
import os

import duckdb
import pytest

from bullgauge.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def show(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert got
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(show(x[names.index(c)]) for c in cols) for x in r.fetchall())
