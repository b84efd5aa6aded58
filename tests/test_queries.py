"""Every query with SQL gives the rows its SQL gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v).isoformat()
    return str(v)


@pytest.fixture(scope="session")
def views(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


CORE = [n for m in entry.MODULES for n in __import__(m, fromlist=["SQL"]).SQL]


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, data, views, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = views.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
