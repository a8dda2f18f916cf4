"""Queries over enriched scans, report texts and the state's lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import facts, reports, risk, select, state
from . import filings as scans
from . import queries_filings as qf
from . import queries_opportunities as qo
from .views import table, view

#: A stated third of all receipts has a document.
DOCUMENTED = "n % 3 = 0"


def _plain_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "disclosures_v").select("rcept_no", "rcept_dt", "corp_code", "stock_code", "report_nm")
    return rows.withColumn("corp_name", F.concat(F.lit("corp "), F.col("corp_code")))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of all kinds, with put options and acquisition funds in some rows."""
    rows = qf._structured(spark, sf)
    rows = rows.withColumns({
        "popt_ctr_atn": F.when(F.col("ord") % 3 == 0, "있음").otherwise("-"),
        "fdpp_bsninh": F.when(F.col("ord") % 2 == 0, F.format_number(F.col("ord") * 5, 0)).otherwise("-"),
    })
    return facts.normalise({k: rows.where(F.col("structured_kind") == k) for k in facts.KINDS}, "rcept_no", "corp_code")


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    """Markup of two rows: a purpose and a sales figure."""
    rows = view(spark, sf, "disclosures_v").select("rcept_no", F.substring("rcept_no", 9, 6).cast("long").alias("n")).where(DOCUMENTED)
    row = lambda a, b: F.concat(F.lit(f"<tr><td>{a}</td><td>"), b, F.lit("</td></tr>"))
    body = F.concat(F.lit("<table>"), row("사업목적", F.col("n").cast("string")), row("매출액", F.concat((F.col("n") * 1000).cast("string"), F.lit("원"))), F.lit("</table>"))
    return rows.select("rcept_no", body.alias("content"))


def _scan(spark: SparkSession, sf: str) -> scans.Scan:
    return scans.scan(_plain_listing(spark, sf), structured=_facts(spark, sf), archives=_archives(spark, sf))


def enr1_enriched_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The scan with structured facts and documents: every reason and warning as text."""
    found = _scan(spark, sf).candidates
    listed = lambda c: F.array_join(c, "|").alias(c)
    return found.select(
        "rcept_no", "attention_score", "financing_risk_score", "band", listed("reasons"), listed("risk_reasons"), listed("warnings"), listed("business_purpose_phrases"),
        F.coalesce("document_row_count", F.lit(0)).alias("document_row_count"), F.col("document_financial_snapshot")["revenue"].alias("revenue"),
    )


def snk3_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Filings as JSON lines with sorted keys and nulls."""
    rows = view(spark, sf, "disclosures_v").select("rcept_no", "corp_code", F.nullif("stock_code", F.lit("")).alias("stock_code"), F.substring("rcept_no", 9, 6).cast("long").alias("n"))
    return rows.select("rcept_no", reports.sorted_json(rows).alias("line"))


def snk5_fact_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled facts of acquisitions, numbers grouped, and the first three of five phrases."""
    rows = _facts(spark, sf).where("structured_kind = 'acquisition'").select("rcept_no", "target_name", "target_business", "acquisition_amount", "asset_ratio_pct", "post_stake_pct", "purpose", "payment_terms")
    rows = rows.withColumn("business_purpose_phrases", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("p"), i.cast("string"))))
    return rows.select("rcept_no", F.array_join(reports.fact_lines(rows), "\n").alias("lines"))


def snk7_format_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice")).alias("v"))
    return rows.select("o_orderkey", S.format_number(F.col("v"), "원").alias("shown"), S.fixed(F.coalesce("v", F.lit(0.0)), 1).alias("one"))


def snk8_opportunity_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The report's block of each shortlisted opportunity."""
    rows = select.pareto_select(qo._scored(spark, sf), qo.QUERY.limit)
    return reports.opportunity_markdown(rows).select("candidate_id", "markdown")


def src14_recent_events(spark: SparkSession, sf: str) -> DataFrame:
    """One company's stored events of three years, in order, from a saved state."""
    at = state.StateTable(spark, f"{select.shared_folder(spark)}/state-{uuid.uuid4().hex}")
    at.save(qf._clustered(spark, sf).select("rcept_no", "rcept_dt", "corp_code", "category", F.lit(1).alias("updated_at")))
    found = at.recent_events("00000301", "19930101", "19951231", "19930101000000")
    return found.select("rcept_no", "rcept_dt", "category")


def lim1_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of 30 rows with a marker: the phrases stop at twenty."""
    from ..sources import documents

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    row = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("<tr><td>신규사업</td><td>"), i.cast("string"), F.lit("</td></tr>")))
    found = documents.document_rows(p.select("id", F.concat(F.lit("<table>"), F.array_join(row, ""), F.lit("</table>")).alias("html")), "id", "html")
    return found.select("id", F.array_join(documents.purpose_phrases(F.col("rows")), ",").alias("phrases"))


def fn3_number(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers from texts, booleans and junk."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("t"))
    t = F.when(F.col("o_orderkey") % 5 == 0, "true").when(F.col("o_orderkey") % 5 == 1, "n/a").when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit(" "), F.col("t"), F.lit(".5 "))).when(F.col("o_orderkey") % 5 == 3, "False")
    return rows.select("o_orderkey", S.number(t, 7.0).alias("number"), S.as_float(t).alias("float"))


QUERIES = {f.__name__: f for f in (enr1_enriched_scan, snk3_jsonl, snk5_fact_lines, snk7_format_number, snk8_opportunity_markdown, src14_recent_events, lim1_phrases, fn3_number)}

# ---- the same in DuckDB SQL ----
_any, _lad = qf._any, qf._lad
_FACTS = qf._CLS + f""", fa AS (SELECT cl.* EXCLUDE (asset_ratio_pct, equity_ratio_pct, dilution_ratio_pct, post_stake_pct),
  kind IS NOT NULL AND substr(rcept_no, 14, 1) <> '7' AS found FROM cl WHERE stock_code <> '' AND category <> 'other'),
fb AS (SELECT *, found AND kind = 'acquisition' AS is_acq, found AND kind IN ('cb', 'bw') AS is_bond, found AND kind = 'equity_issuance' AS is_eq,
  n % 3 = 0 AND (needs OR NOT found) AS doc FROM fa),
ev2 AS (SELECT * REPLACE (CASE WHEN is_acq THEN purpose END AS purpose, CASE WHEN is_acq THEN payment_terms END AS payment_terms),
  CASE WHEN is_acq THEN n % 160 + 0.5::DOUBLE END AS asset, CASE WHEN is_acq THEN CAST(n % 100 AS DOUBLE) END AS post,
  CASE WHEN found AND kind = 'cb' THEN 24.35::DOUBLE WHEN is_eq THEN 25.0::DOUBLE END AS dil,
  CASE WHEN is_bond OR is_eq THEN CAST(n * 7 AS DOUBLE) END AS debt_funds, (is_bond OR is_eq) AND n % 2 = 0 AND n > 0 AS buys,
  CASE WHEN is_bond OR is_eq THEN issue_method ELSE '' END AS method,
  category = 'portfolio_pivot' AND (subtype <> 'shareholder_meeting_agenda' OR doc) AS piv FROM fb),
rl AS (SELECT a.rcept_no, b.category AS c, b.piv AS p FROM ev2 a JOIN ev2 b ON {qf._NEAR} AND {qf._BEFORE}),
rs AS (SELECT rcept_no, bool_or(c = 'acquisition_control') AS x_acq, bool_or(c = 'financing_dilution') AS x_fin, bool_or(c = 'governance_change') AS x_gov, bool_or(p) AS x_piv FROM rl GROUP BY rcept_no),
jo AS (SELECT ev2.*, coalesce(x_acq, false) AS m_acq, coalesce(x_fin, false) AS m_fin, coalesce(x_gov, false) AS m_gov, coalesce(x_piv, false) AS m_piv,
  category = 'acquisition_control' AS acq, category = 'financing_dilution' AS fin, category = 'execution_validation' AS exe, category = 'portfolio_pivot' AS pv, category = 'governance_change' AS gov,
  subtype = 'shareholder_meeting_agenda' AS agenda FROM ev2 LEFT JOIN rs USING (rcept_no))"""


def _said(name: str, *values: str) -> str:
    parts = risk.SAID[name].split("{}")
    out = [f"'{parts[0]}'"]
    for v, rest in zip(values, parts[1:], strict=True):
        out += [v, f"'{rest}'"]
    return " || ".join(out)


_one = lambda x: f"printf('%.1f', {x})"
_DR = _lad("dil", risk.DILUTION_LEVELS)
_CONTROL = f"(coalesce(post >= 50, false) OR {_any('purpose', facts.CONTROL_WORDS)})"
_NEWB = "is_acq"  # the target's business is always one of the words
#: condition, attention, risk, reason, risk reason: in the order of the rules.
_RULES = (
    ("base > 0", "base", "0", _said("base", "category || '/' || subtype", "base"), None), ("corr", "0", "0", _said("correction"), None),
    (f"acq AND is_acq AND {_CONTROL}", "20", "0", _said("control"), None), ("acq AND asset >= 10", _lad("asset", risk.ASSET_LEVELS), "0", _said("asset", _one("asset")), None),
    ("acq AND asset >= 50", "0", _lad("asset", risk.HEAVY_LEVELS), None, _said("asset_risk", _one("asset"))), (f"acq AND {_NEWB}", "8", "0", _said("new_business"), None),
    ("acq AND is_acq", "2", "0", _said("target"), None), (f"acq AND is_acq AND {_any('payment_terms', facts.DEBT_WORDS)}", "0", "15", None, _said("debt")),
    ("acq AND is_acq AND n % 3 = 0", "0", "5", None, _said("put")), (f"fin AND {_DR} > 0", f"least({_DR} * 0.25, 10)", _DR, _said("dilution"), _said("dilution_risk", _one("dil"))),
    ("fin AND buys", "15", "0", _said("funding"), None), ("fin AND debt_funds > 0", "0", "10", None, _said("repayment")), ("fin AND (contains(method, '제3자') OR contains(method, '사모'))", "0", "5", None, _said("method", "method")),
    ("pv AND doc AND agenda", "35", "0", _said("agenda"), None), ("pv AND doc AND NOT agenda", "15", "0", _said("phrases"), None), ("pv AND doc", "3", "0", _said("snapshot"), None),
    ("exe AND m_acq", "20", "0", _said("after_acquisition"), None), ("exe AND NOT m_acq AND m_piv", "12", "0", _said("after_pivot"), None),
    ("(acq AND m_fin) OR (fin AND m_acq)", "10", "20", _said("leveraged"), _said("leveraged_risk")), ("(acq AND m_piv) OR (piv AND m_acq)", "10", "0", _said("scope"), None),
    ("(gov AND m_acq) OR (acq AND m_gov)", "8", "5", _said("governance"), _said("governance_risk")),
)
_sum = lambda k: "round(least(CAST(" + " + ".join(f"CASE WHEN {r[0]} THEN {r[k]} ELSE 0 END" for r in _RULES if r[k] != "0") + " AS DOUBLE), 100), 1)"
_texts = lambda k: "concat_ws('|', " + ", ".join(f"CASE WHEN {r[0]} THEN {r[k]} END" for r in _RULES if r[k]) + ")"
_MONEY = "CASE WHEN {v} = floor({v}) THEN format('{{:,}}', CAST({v} AS BIGINT)) ELSE format('{{:,.2f}}', {v}) END"
_AX = "printf('%.3f', {})"
ORACLES = {
    "enr1_enriched_scan": _FACTS + f""", sc AS (SELECT *, {_sum(1)} AS att, {_sum(2)} AS rsk FROM jo)
SELECT rcept_no, att AS attention_score, rsk AS financing_risk_score, CASE WHEN att >= 75 THEN 'urgent' WHEN att >= 55 THEN 'review' WHEN att >= 35 THEN 'watch' ELSE 'low' END AS band,
  {_texts(3)} AS reasons, {_texts(4)} AS risk_reasons, CASE WHEN kind IS NOT NULL AND NOT found THEN '접수번호와 일치하는 ' || kind || ' 구조화 행을 찾지 못함' ELSE '' END AS warnings,
  CASE WHEN doc THEN '사업목적 | ' || n || '|매출액 | ' || n * 1000 || '원' END AS business_purpose_phrases, CAST(CASE WHEN doc THEN 2 ELSE 0 END AS INTEGER) AS document_row_count,
  CASE WHEN doc THEN CAST(n * 1000 AS DOUBLE) END AS revenue FROM sc""",
    "snk3_jsonl": qf._V + """ SELECT rcept_no, '{"corp_code":"' || corp_code || '","n":' || CAST(substr(rcept_no, 9) AS BIGINT) || ',"rcept_no":"' || rcept_no || '","stock_code":' || CASE WHEN stock_code = '' THEN 'null' ELSE '"' || stock_code || '"' END || '}' AS line FROM disclosures_v""",
    "snk5_fact_lines": qf._ST + f""", v AS (SELECT *, CAST(n * 1000 AS DOUBLE) AS amt, n % 160 + 0.5::DOUBLE AS ar, CAST(n % 100 AS DOUBLE) AS ps FROM st WHERE kind = 'acquisition')
SELECT rcept_no, concat_ws(chr(10), '- 인수대상: target ' || n, '- 인수대상 주요사업: 신성장', '- 인수금액: ' || {_MONEY.format(v='amt')} || '원', '- 총자산 대비: ' || {_MONEY.format(v='ar')} || '%', '- 인수 후 지분: ' || {_MONEY.format(v='ps')} || '%',
  CASE WHEN purpose <> '' THEN '- 목적: ' || purpose END, CASE WHEN payment_terms <> '' THEN '- 지급조건: ' || payment_terms END, '- 사업목적 관련 원문: p1 / p2 / p3') AS lines FROM v""",
    "snk7_format_number": f"WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, CASE WHEN v IS NULL THEN '-' ELSE {_MONEY.format(v='v')} || '원' END AS shown, printf('%.1f', coalesce(v, 0.0)) AS one FROM o",
    "snk8_opportunity_markdown": qo._SCORED + qo._peel(1) + f""", t AS (SELECT *, row_number() OVER (ORDER BY {qo._BY}) AS rank FROM l1 QUALIFY rank <= 10)
SELECT t.candidate_id, concat_ws(chr(10), '## ' || rank || '. ' || t.title || chr(10), '- mechanism: ' || coalesce(mechanism, 'unknown'), '- permission: ' || coalesce(permission_status, 'unknown'), '- experiment: n/a', '- pass: n/a', '- kill: n/a',
  '- validation cost: $' || coalesce(CAST(cash_usd AS VARCHAR), '0') || ' cash / ' || coalesce(CAST(human_hours AS VARCHAR), '0') || ' human-hours / ' || coalesce(CAST(feedback_days AS VARCHAR), '0') || ' days feedback' || chr(10),
  '| axis | value |', '|---|---:|', {", ".join(f"'| {a} | ' || " + _AX.format(f"t.{a}") + " || ' |'" for a in reports.AXIS_ORDER)}, '') AS markdown FROM t JOIN opportunities_v v ON v.candidate_id = t.candidate_id""",
    "src14_recent_events": qf._CLS + " SELECT rcept_no, rcept_dt, category FROM ev WHERE corp_code = '00000301' AND rcept_dt BETWEEN '19930101' AND '19951231'",
    "lim1_phrases": "SELECT p_partkey AS id, array_to_string([ '신규사업 | ' || i FOR i IN range(1, 21)], ',') AS phrases FROM part",
    "fn3_number": "WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'n/a' WHEN 2 THEN o_orderkey || '.5' WHEN 3 THEN 'False' END AS t FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 3 THEN 0.0 ELSE coalesce(try_cast(t AS DOUBLE), 7.0) END AS number, CASE WHEN o_orderkey % 5 = 2 THEN try_cast(t AS DOUBLE) END AS float FROM o",
}
