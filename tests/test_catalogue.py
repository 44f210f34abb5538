"""Every registered query with SQL against DuckDB on the same tables, the others for a stable schema."""

from __future__ import annotations

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from quire.plans import catalogue

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(out.columns) == sorted(columns)
    expected = Counter(tuple(map(plain, r)) for r in found.fetchall())
    actual = Counter(tuple(map(plain, r)) for r in out.select(*[f"`{c}`" for c in columns]).collect())
    assert actual == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    out = QUERIES[name](spark, DATA)
    rows = out.collect()
    assert len(out.columns) == len(set(out.columns))
    assert rows, "the test tables have rows for every query"
