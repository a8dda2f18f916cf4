"""Registered queries against their SQL where several filings share a receipt (order keys of seven digits are cut)."""

import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright.plans import registry
from sievewright.plans.filings import candidates

NAMES = ["agg10_related_categories", "enr1_enriched_scan", "jn3_cluster", "jn4_merge"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    keys = [*range(150_000, 150_040), *range(1_500_000, 1_500_400), *range(3_000, 3_040)]
    day = datetime.datetime(1995, 3, 1)
    # Filings of one receipt are of different companies, or of different kinds.
    rows = [(k, k % 11 + 11 * (k < 1_000_000), day + datetime.timedelta(days=int(str(k)[:6]) % 40)) for k in keys]
    folder = str(tmp_path_factory.mktemp("shared"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_where_filings_share_a_receipt(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{Path(sf)}/orders.parquet/*.parquet'")
    shared = con.sql(registry.ORACLES["flt7_other"]).fetchall()
    assert len(set(shared)) < len(shared)
    got, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    pick = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in names]) for r in rows)
    assert sorted(want.columns) == names and pick(got.columns, got.collect()) == pick(want.columns, want.fetchall())


def test_scan_order_leaves_no_tie_open(spark):
    """Filings of one receipt with equal scores have one order, however the rows come."""
    rows = spark.range(40).selectExpr(
        "'20240101000001' AS rcept_no", "'20240101' AS rcept_dt", "concat('corp ', lpad(id, 2, '0')) AS corp_name", "'name' AS report_nm", "1.0D AS attention_score", "0.0D AS financing_risk_score",
        "'other' AS category", "'low' AS band", "CAST(array() AS array<string>) AS cluster_tags",
    )
    for descending in (True, False):
        given = rows.orderBy(F.col("corp_name").desc() if descending else F.col("corp_name").asc()).coalesce(1)
        assert [r.title for r in candidates(given).orderBy("ord").collect()] == [f"corp {i:02} — name" for i in range(40)]
