"""The driver's contract: every query with SQL gives the same rows in DuckDB (smallest tables)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    return v if v is None or isinstance(v, bool | str) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(v) for v in r]) for r in cur.fetchall())
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.ORACLES) <= set(catalog.QUERIES)
