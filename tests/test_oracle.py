"""Every query with SQL gives the same rows in an independent engine."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(map(plain, r)) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in df.columns]
    assert len(names) == len(df.columns)
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 35
    assert set(entry.oracle_sql()) <= set(entry.queries())
