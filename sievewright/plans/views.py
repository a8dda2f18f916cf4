"""Synthetic views over the parquet tables; one text for Spark SQL and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

OPPORTUNITIES_V = """
SELECT p.p_partkey AS candidate_id, p.p_name AS title, p.p_type AS mechanism,
  CASE WHEN p.p_partkey % 23 = 0 THEN 'PROHIBITED' WHEN p.p_partkey % 19 = 0 THEN NULL
       WHEN p.p_partkey % 7 = 0 THEN 'authorized-only' ELSE 'allowed' END AS permission_status,
  CAST(COALESCE(s.n_sup, 0) % 6 AS DOUBLE) AS independent_revenue_signals,
  CAST(p.p_partkey % 97 AS DOUBLE) / 96 AS demand_strength,
  CAST(p.p_partkey % 89 AS DOUBLE) / 80 AS automation_fit,
  CAST(p.p_partkey % 83 AS DOUBLE) / 82 AS repeatability,
  CAST(p.p_size AS DOUBLE) / 50 AS distribution_access,
  CAST(p.p_partkey % 71 AS DOUBLE) / 70 AS upside_convexity,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_retailprice / 3 END AS cash_usd,
  CAST(p.p_partkey % 30 AS DOUBLE) AS human_hours,
  CAST(p.p_partkey % 15 AS DOUBLE) AS feedback_days,
  CAST(p.p_partkey % 11 AS DOUBLE) / 20 AS capital_at_risk,
  CAST(p.p_partkey % 17 AS DOUBLE) / 20 AS platform_policy,
  CAST(p.p_partkey % 5 AS DOUBLE) / 20 AS legal
FROM part p LEFT JOIN (SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS n_sup FROM lineitem GROUP BY l_partkey) s
  ON p.p_partkey = s.l_partkey
"""

CATALOG_V = """
SELECT CONCAT('SKU-', CAST(p_partkey AS STRING)) AS sku,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS price,
  CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE p_size END AS inventory
FROM part WHERE p_partkey % 31 <> 0
"""

ORDER_LINES_V = """
SELECT l.l_orderkey AS order_id,
  ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity, l.l_shipdate) - 1 AS line_index,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 29 = 0 THEN '' ELSE CONCAT('SKU-', CAST(l.l_partkey AS STRING)) END AS sku,
  CASE WHEN (l.l_orderkey + l.l_partkey) % 37 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN l.l_partkey % 53 = 0 THEN CAST(1.5 AS DECIMAL(18,2))
       ELSE CAST(l.l_quantity AS DECIMAL(18,2)) END AS quantity,
  CASE WHEN (l.l_orderkey + l.l_partkey) % 47 = 0 THEN CAST(-1 AS DECIMAL(18,2))
       WHEN (l.l_partkey + l.l_linenumber) % 5 = 0 THEN CAST(p.p_retailprice + 1 AS DECIMAL(18,2))
       ELSE CAST(p.p_retailprice AS DECIMAL(18,2)) END AS unit_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

ORDER_HEADERS_V = """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE CONCAT('PO-', CAST(o_orderkey % 14000 AS STRING)) END AS purchase_order_number,
  CASE WHEN o_orderkey % 103 = 0 THEN '' ELSE CONCAT('CUST-', CAST(o_custkey AS STRING)) END AS customer_id,
  CASE WHEN o_orderkey % 107 = 0 THEN '' ELSE 'usd' END AS currency
FROM orders
"""

DISCLOSURES_V = """
SELECT CONCAT(CAST(YEAR(o_orderdate) * 10000 + MONTH(o_orderdate) * 100 + DAY(o_orderdate) AS STRING), LPAD(CAST(o_orderkey AS STRING), 6, '0')) AS rcept_no,
  CAST(YEAR(o_orderdate) * 10000 + MONTH(o_orderdate) * 100 + DAY(o_orderdate) AS STRING) AS rcept_dt,
  CAST(o_orderdate AS DATE) AS rcept_date,
  LPAD(CAST(o_custkey AS STRING), 8, '0') AS corp_code,
  CASE WHEN o_custkey % 17 = 0 THEN '' ELSE LPAD(CAST(o_custkey AS STRING), 6, '0') END AS stock_code,
  CASE o_orderkey % 14
    WHEN 0 THEN '주요사항보고서(타법인 주식 및 출자증권 양수결정)' WHEN 1 THEN '[기재정정]주요사항보고서(전환사채권 발행결정)'
    WHEN 2 THEN '단일판매ㆍ공급계약체결' WHEN 3 THEN '주주총회소집공고' WHEN 4 THEN '최대주주변경'
    WHEN 5 THEN '회사합병결정' WHEN 6 THEN '영업양도결정' WHEN 7 THEN '신주인수권부사채권발행결정'
    WHEN 8 THEN '교환사채권발행결정' WHEN 9 THEN '유상증자결정' WHEN 10 THEN '채무보증결정'
    WHEN 11 THEN '[첨부추가] 신규시설투자' WHEN 12 THEN '최대주주변경을수반하는주식양수도계약체결' ELSE '기업설명회개최' END AS report_nm,
  CAST(o_orderkey % 160 AS DOUBLE) AS asset_ratio_pct, CAST(o_orderkey % 130 AS DOUBLE) AS equity_ratio_pct,
  CAST(o_custkey % 60 AS DOUBLE) AS dilution_ratio_pct, CAST(o_orderkey % 100 AS DOUBLE) AS post_stake_pct,
  CASE o_orderkey % 4 WHEN 0 THEN '경영권 확보' WHEN 1 THEN '신규사업 진출' WHEN 2 THEN '단순투자' ELSE '' END AS purpose,
  CASE o_orderkey % 3 WHEN 0 THEN '인수금융' WHEN 1 THEN '자기자금' ELSE '' END AS payment_terms,
  CASE WHEN o_orderkey % 5 = 0 THEN '사모' ELSE '공모' END AS issue_method,
  CASE WHEN o_orderkey % 6 = 0 THEN 1000000.0 ELSE 0.0 END AS funds_debt_repayment
FROM orders
"""

COMMA_NUMBERS_V = """
SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN '51,000,000,000원' WHEN 1 THEN '-' WHEN 2 THEN '24.35%' WHEN 3 THEN '17,271,157주'
  WHEN 4 THEN '없음' ELSE CONCAT('약 ', CAST(o_custkey AS STRING), '원') END AS raw FROM orders
"""

SEEN_PO_V = """
SELECT DISTINCT CONCAT('PO-', CAST(o_orderkey AS STRING)) AS po FROM orders WHERE o_orderkey % 10 = 0
"""

VIEWS = {
    "opportunities_v": OPPORTUNITIES_V,
    "catalog_v": CATALOG_V,
    "order_lines_v": ORDER_LINES_V,
    "order_headers_v": ORDER_HEADERS_V,
    "disclosures_v": DISCLOSURES_V,
    "comma_numbers_v": COMMA_NUMBERS_V,
    "seen_po_v": SEEN_PO_V,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the directory, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A synthetic view; the tables that it names are passed to its text as frames."""
    sql = VIEWS[name]
    names = dict.fromkeys(re.findall(r"(?:FROM|JOIN) (part|lineitem|orders)\b", sql))
    frames = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (part|lineitem|orders)\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}")), **frames)


def with_views(*names: str) -> str:
    """The start of a DuckDB query that uses views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
