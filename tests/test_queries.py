"""Every registered query of the library against DuckDB over the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    r = con.execute(catalog.SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(at)
    want = sorted((tuple(plain(x[at.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
