"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from matchloom.plans import registry

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL)
    rows = got.collect()
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    place = [want.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
