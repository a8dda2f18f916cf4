"""Queries over purchase orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orders
from .views import view, with_views


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return orders.validate_lines(view(spark, sf, "order_lines_v"), view(spark, sf, "catalog_v"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return orders.summarise_orders(view(spark, sf, "order_headers_v"), _lines(spark, sf), view(spark, sf, "seen_po_v"))


def ord1_line_status(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts are decimals in the operator; here they are doubles, as every client reads those alike."""
    return _lines(spark, sf).select(
        "order_id", F.col("line_index").cast("long").alias("line_index"), "status", F.array_join("codes", ",").alias("codes"), F.col("line_total").cast("double").alias("line_total")
    )


def ord1_order_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select(
        "order_id", "status", "purchase_order_number", "customer_id", "currency", F.size("exceptions").alias("n_exceptions"),
        F.array_join(F.filter(F.transform("exceptions", lambda e: F.when(e["line_index"].isNull(), e["code"])), lambda c: c.isNotNull()), ",").alias("order_codes"),
    )


def agg3_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("order_id", F.col("order_total").cast("double").alias("order_total"), F.col("quarantined_total").cast("double").alias("quarantined_total"))


def agg4_collected(spark: SparkSession, sf: str) -> DataFrame:
    """Exceptions and lines of every order, collected in order."""
    return _orders(spark, sf).select(
        "order_id", F.array_join(F.transform("exceptions", lambda e: F.concat_ws(":", e["line_index"].cast("string"), e["code"])), ",").alias("exceptions"),
        F.array_join(F.transform("normalized_lines", lambda x: x["line_index"].cast("string")), ",").alias("clean_lines"),
        F.array_join(F.transform("quarantined_lines", lambda x: x["line_index"].cast("string")), ",").alias("quarantined_lines"),
    )


def jn5_catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where("array_contains(codes, 'unknown_sku')").select("order_id", "line_index", "sku")


def jn6_duplicate_po(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).where(F.exists("exceptions", lambda e: e["code"] == "duplicate_po")).select("order_id", "purchase_order_number")


QUERIES = {f.__name__: f for f in (ord1_line_status, ord1_order_summary, agg3_totals, agg4_collected, jn5_catalog_lookup, jn6_duplicate_po)}

_V = with_views("order_lines_v", "catalog_v", "order_headers_v", "seen_po_v")
_LINE = _V + """, ln AS (SELECT l.order_id, l.line_index, trim(l.sku) AS sku,
  CASE WHEN trim(l.sku) = '' THEN 'missing_sku' WHEN quantity IS NULL OR quantity <= 0 OR quantity <> floor(quantity) THEN 'invalid_quantity'
    WHEN unit_price IS NULL OR unit_price < 0 THEN 'invalid_price' WHEN c.sku IS NULL THEN 'unknown_sku' END AS stop,
  CASE WHEN price IS NULL THEN 'catalog_price_missing' WHEN abs(unit_price - price) > 0.01 THEN 'price_mismatch' END AS pc,
  CASE WHEN inventory IS NULL THEN 'inventory_missing' WHEN quantity > inventory THEN 'insufficient_inventory' END AS ic,
  CAST(quantity * unit_price AS DECIMAL(38,6)) AS total FROM order_lines_v l LEFT JOIN catalog_v c ON trim(l.sku) = c.sku),
st AS (SELECT order_id, line_index, sku, CASE WHEN stop IS NOT NULL THEN 'unpriced' WHEN pc IS NOT NULL OR ic IS NOT NULL THEN 'quarantined' ELSE 'clean' END AS status,
  coalesce(stop, concat_ws(',', pc, ic)) AS codes, CASE WHEN stop IS NULL THEN total END AS line_total FROM ln),
sm AS (SELECT order_id, count(*) AS n, sum(len(string_split(codes, ','))) FILTER (WHERE codes <> '') AS nx,
  sum(line_total) FILTER (WHERE status = 'clean') AS t, sum(line_total) FILTER (WHERE status = 'quarantined') AS qt,
  string_agg(array_to_string(list_transform(string_split(codes, ','), lambda c: line_index || ':' || c), ','), ',' ORDER BY line_index) FILTER (WHERE codes <> '') AS xs,
  string_agg(CAST(line_index AS VARCHAR), ',' ORDER BY line_index) FILTER (WHERE status = 'clean') AS cl,
  string_agg(CAST(line_index AS VARCHAR), ',' ORDER BY line_index) FILTER (WHERE status <> 'clean') AS ql FROM st GROUP BY order_id),
od AS (SELECT h.order_id, purchase_order_number AS po, h.customer_id AS cu, upper(h.currency) AS cur, sm.*EXCLUDE(order_id),
  concat_ws(',', CASE WHEN purchase_order_number = '' THEN 'missing_po_number' END, CASE WHEN s.po IS NOT NULL THEN 'duplicate_po' END,
    CASE WHEN h.customer_id = '' THEN 'missing_customer' END, CASE WHEN h.currency = '' THEN 'missing_currency' END, CASE WHEN n IS NULL THEN 'missing_lines' END) AS oc
  FROM order_headers_v h LEFT JOIN sm ON h.order_id = sm.order_id LEFT JOIN seen_po_v s ON h.purchase_order_number = s.po)"""
_NX = "(CASE WHEN oc = '' THEN 0 ELSE len(string_split(oc, ',')) END + coalesce(nx, 0))"
ORACLES = {
    "ord1_line_status": _LINE + " SELECT order_id, line_index, status, codes, CAST(line_total AS DOUBLE) AS line_total FROM st",
    "ord1_order_summary": _LINE + f" SELECT order_id, CASE WHEN {_NX} = 0 THEN 'ready_for_draft' ELSE 'needs_review' END AS status, nullif(po, '') AS purchase_order_number, nullif(cu, '') AS customer_id, nullif(cur, '') AS currency, CAST({_NX} AS INTEGER) AS n_exceptions, oc AS order_codes FROM od",
    "agg3_totals": _LINE + " SELECT order_id, CAST(coalesce(t, 0) AS DOUBLE) AS order_total, CAST(coalesce(qt, 0) AS DOUBLE) AS quarantined_total FROM od",
    "agg4_collected": _LINE + " SELECT order_id, concat_ws(',', nullif(oc, ''), xs) AS exceptions, coalesce(cl, '') AS clean_lines, coalesce(ql, '') AS quarantined_lines FROM od",
    "jn5_catalog_lookup": _LINE + " SELECT order_id, line_index, sku FROM st WHERE codes = 'unknown_sku'",
    "jn6_duplicate_po": _LINE + " SELECT order_id, po AS purchase_order_number FROM od WHERE oc LIKE '%duplicate_po%'",
}
