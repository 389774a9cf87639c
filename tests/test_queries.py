"""Every registered query of the library proper gives the rows of its oracle."""

import datetime
import math
import os

import duckdb
import pytest

from sheetwright.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in registry.ORACLES:
        return
    rel = duck.sql(registry.ORACLES[name])
    cols = rel.columns
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(repr(tuple(plain(r[cols.index(c)]) for c in order)) for r in rel.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in order)) for r in rows) == want


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
