"""Registered queries against their SQL on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sievewright.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, Decimal) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES) and registry.FLAGSHIP in registry.QUERIES


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    pick = lambda columns, rows: sorted((repr([plain(r[columns.index(c)]) for c in names]) for r in rows))
    assert pick(got.columns, got.collect()) == pick(want.columns, want.fetchall())
