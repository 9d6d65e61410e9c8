"""Every registered query runs; those with a SQL counterpart give its rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def canonical(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u", "f"):
            return repr(round(float(v), 6))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
