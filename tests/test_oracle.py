"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from gleaner import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def level(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(level(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE:
        assert got
        return
    out = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(level(r[i]) for i in at) for r in out.fetchall())
