"""Queries over filings, documents and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cluster, facts, gates, risk, state, taxonomy
from ..sources import documents, filings
from . import filings as scans
from .views import table, view, with_views

#: A stated tenth of all receipts counts as processed by earlier runs.
SEEN = "CAST(substr(rcept_no, 9) AS BIGINT) % 10 = 0"


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "disclosures_v")
    return rows.withColumns({
        **facts.flags(F.col("post_stake_pct"), F.col("purpose"), F.lit(""), F.col("payment_terms")),
        "corp_name": F.concat(F.lit("corp "), F.col("corp_code")),
        # Agendas of every third receipt have phrases.
        "business_purpose_phrases": F.when(F.substring("rcept_no", 9, 6).cast("int") % 3 == 0, F.array(F.lit("사업목적"))),
    })


def _scan(spark: SparkSession, sf: str, **options) -> scans.Scan:
    return scans.scan(_listing(spark, sf), **options)


def src5_date_windows(spark: SparkSession, sf: str) -> DataFrame:
    return filings.window_frame(spark, "20240101", "20241231")


def src6_from_listing(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select(
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("corp_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")).alias("rcept_no"), F.lit("Y").alias("corp_cls")
    )
    return gates.with_receipt(filings.from_listing(raw))


def agg2_receipts_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("rcept_no"), F.col("event_type").alias("report_nm"), F.col("event_id").alias("fetch_order"))
    return filings.last_fetched(raw).select("rcept_no", "report_nm")


def src7_structured_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = taxonomy.classify(view(spark, sf, "disclosures_v"))
    return filings.structured_rows(rows, "cb", "00000301", "19920101", "19991231").select("rcept_no", "rcept_dt")


def cls1_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    rows = taxonomy.classify(view(spark, sf, "disclosures_v"))
    return rows.select("rcept_no", "category", "subtype", "base_attention", "structured_kind", "requires_document", "is_correction", F.array_join("tags", ",").alias("tags"))


def flt6_unlisted(spark: SparkSession, sf: str) -> DataFrame:
    return gates.listed_only(view(spark, sf, "disclosures_v")).select("rcept_no")


def flt7_other(spark: SparkSession, sf: str) -> DataFrame:
    return gates.classified_only(taxonomy.classify(view(spark, sf, "disclosures_v"))).select("rcept_no")


def fn8_parse_number(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "comma_numbers_v").select("k", S.parse_number(F.col("raw")).alias("number"))


def fn14_prefix(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("report_nm")
    return view(spark, sf, "disclosures_v").select("rcept_no", S.strip_prefixes(x).alias("name"), S.is_correction(x).alias("corrected"), S.compact_name(x).alias("compact_name"), S.compact_cell(x).alias("compact_cell"))


def fn_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """The small scalar functions on stated inputs made from order columns."""
    rows = table(spark, sf, "orders")
    v = (F.col("o_totalprice") / 1000).alias("v")
    rows = rows.select("o_orderkey", v, F.concat_ws(",", F.col("o_orderstatus"), F.lit(" "), F.lit(" b ")).alias("csv"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"))
    x = F.col("v")
    return rows.select(
        "o_orderkey", F.round(S.unit(x / 400), 9).alias("unit"), S.band(x).alias("band"), S.band_rank(S.band(x)).alias("band_rank"), S.ladder(x, risk.ASSET_LEVELS).alias("points"),
        F.array_join(S.csv_values(F.col("csv")), "|").alias("csv"), S.minus_days(F.col("d"), 30).alias("earlier"), S.viewer_url(F.col("d")).alias("url"),
        F.round(S.ratio(x, x - F.floor(x / 7) * 7), 6).alias("ratio"), S.sum_or_null(F.nullif(F.floor(x % 3), F.lit(0)).cast("double"), F.nullif(F.floor(x % 2), F.lit(0)).cast("double")).alias("sum"),
        F.round(S.clamp_score(F.floor(x)), 1).alias("clamped"), S.positive_sum(F.floor(x % 5) - 2, F.floor(x % 7) - 3).alias("positive"),
    )


def _structured(spark: SparkSession, sf: str) -> DataFrame:
    """Structured rows made from orders: comma-grouped numbers as the service gives them."""
    d = taxonomy.classify(view(spark, sf, "disclosures_v")).where("structured_kind IS NOT NULL AND substr(rcept_no, 14, 1) <> '7'")
    n = F.substring("rcept_no", 9, 6).cast("long")
    num = lambda k: F.format_number(n * k, 0)
    raw = {
        "iscmp_cmpnm": F.concat(F.lit(" target "), n.cast("string")), "iscmp_mbsn": F.lit("신성장"), "inhdtl_inhprc": F.concat(num(1000), F.lit("원")), "inhdtl_tast_vs": F.concat((n % 160).cast("string"), F.lit(".5%")),
        "atinh_eqrt": (n % 100).cast("string"), "inh_pp": F.col("purpose"), "dl_pym": F.col("payment_terms"), "popt_ctr_atn": F.lit("-"),
        "bd_fta": num(100), "cv_prc": num(3), "ex_prc": num(4), "cvisstk_tisstk_vs": F.lit("24.35"), "nstk_isstk_tisstk_vs": F.lit("-"), "bdis_mthn": F.col("issue_method"), "fdpp_dtrp": num(7),
        "nstk_ostk_cnt": num(2), "nstk_estk_cnt": F.lit("-"), "bfic_tisstk_ostk": num(8), "ic_mthn": F.col("issue_method"),
    }
    return d.select("structured_kind", "corp_code", "rcept_no", "rcept_dt", n.alias("ord"), *(v.alias(k) for k, v in raw.items()))


def _facts(kind: str, *columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _structured(spark, sf).where(F.col("structured_kind") == kind)
        return facts.normalise({kind: rows}, "rcept_no").select("rcept_no", *columns)

    return run


def prj5_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = _structured(spark, sf)
    made = facts.normalise({k: rows.where(F.col("structured_kind") == k) for k in facts.KINDS}, "rcept_no")
    return made.select("rcept_no", "structured_kind", "instrument", F.round("dilution_ratio_pct", 6).alias("dilution_ratio_pct"), "issue_method")


def jn2_structured_match(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with the receipts of their structured rows; corrections' rows are dated ten days earlier."""
    d = taxonomy.classify(view(spark, sf, "disclosures_v"))
    rows = _structured(spark, sf)
    rows = rows.withColumn("rcept_dt", F.when(F.col("structured_kind") == "cb", S.minus_days(F.col("rcept_dt"), 10)).otherwise(F.col("rcept_dt")))
    found = facts.match_structured(d, rows)
    return found.select("rcept_no", F.col("matched.ord").alias("matched_ord"), facts.match_warning(found).isNotNull().alias("warned"))


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    return risk.with_facts(gates.classified_only(taxonomy.classify(gates.listed_only(_listing(spark, sf)))))


def jn3_cluster(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.by_receipt(cluster.related_events(_clustered(spark, sf)))
    return found.select("rcept_no", F.array_join(F.transform("related", lambda e: e["rcept_no"]), ",").alias("related"))


def jn4_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored events (a third of all) beside the run's: stored ones of the day count whatever their receipt."""
    rows = _clustered(spark, sf)
    stored = rows.where("CAST(substr(rcept_no, 9) AS BIGINT) % 3 = 0")
    found = cluster.by_receipt(cluster.related_events(rows, stored))
    return found.select("rcept_no", F.array_join(F.transform("related", lambda e: e["rcept_no"]), ",").alias("related"))


def jn1_seen_anti(spark: SparkSession, sf: str) -> DataFrame:
    rows = _clustered(spark, sf)
    return cluster.unseen(rows, rows.where(SEEN)).select("rcept_no")


def scr1_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = _scan(spark, sf).candidates
    return found.select("rcept_no", "attention_score", "financing_risk_score", "band", F.array_join("cluster_tags", ",").alias("cluster_tags"), F.size("reasons").alias("n_reasons"), F.size("risk_reasons").alias("n_risk_reasons"))


def flt8_band(spark: SparkSession, sf: str) -> DataFrame:
    return gates.at_least_band(_scan(spark, sf).candidates, "review").select("rcept_no", "band")


def srt1_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the fifty first filings in scan order."""
    from pyspark.sql import Window

    order = [F.col(c).desc() for c in ("attention_score", "financing_risk_score", "rcept_dt", "rcept_no")]
    return risk.ranked(_scan(spark, sf).candidates).limit(50).select("rcept_no", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def src3_adapter(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.candidates(_scan(spark, sf).candidates)
    return found.select("candidate_id", "title", "attention_score", F.array_join("tags", ",").alias("tags"), "ord")


def agg7_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listing(spark, sf)
    return scans.scan(rows, seen=rows.where(SEEN)).counters


def agg10_related_categories(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.by_receipt(cluster.related_events(_clustered(spark, sf))).where("size(related) > 0")
    return found.select("rcept_no", F.array_join(F.array_sort(F.array_distinct(F.transform("related", lambda e: e["category"]))), ",").alias("categories"))


def src10_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages have no table, so each is one row of its text."""
    found = documents.document_rows(table(spark, sf, "pages"), "page_id", "html")
    return found.select("page_id", F.size("rows").alias("n_rows"), F.get(F.get("rows", F.lit(0)), F.lit(0)).alias("cell"))


def _markup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = [
        F.concat(F.lit("<tr><td>"), F.col("p_name"), F.lit("</td><td>"), k.cast("string"), F.lit("</td></tr>")),
        F.when(k % 2 == 0, F.lit("<tr><th>제2호 신규 사업</th><td>정관 변경</td></tr>")).otherwise(F.lit("<tr><td> </td></tr>")),
        F.concat(F.lit("<tr><td>매출액</td><td>-</td><td>"), F.format_number(k * 1000, 0), F.lit("원</td></tr>")),
        F.concat(F.lit("<tr><td>자산 총계</td><td>"), F.when(k % 3 == 0, F.lit("없음")).otherwise(k.cast("string")), F.lit("</td></tr>")),
        F.lit("<tr><td>총자산</td><td>7</td></tr>"),
    ]
    return p.select(k.alias("id"), F.concat(F.lit("<table>"), *rows, F.lit("</table>")).alias("html"))


def fn20_phrases(spark: SparkSession, sf: str) -> DataFrame:
    found = documents.document_rows(_markup(spark, sf), "id", "html")
    return found.select("id", F.array_join(documents.purpose_phrases(F.col("rows")), " // ").alias("phrases"))


def fn21_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    found = documents.document_rows(_markup(spark, sf), "id", "html")
    m = documents.financial_snapshot(F.col("rows"))
    return found.select("id", m["revenue"].alias("revenue"), m["assets"].alias("assets"), m["equity"].alias("equity"))


def snk1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each user as a state table: early events saved, then all of them."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("rcept_no"), "event_type", F.struct("ts", "event_id").alias("updated_at"))
    early = cluster.latest_by_key(e.where("updated_at.event_id % 2 = 0"), "rcept_no", "updated_at")
    late = cluster.latest_by_key(e.where("updated_at.event_id % 2 = 1"), "rcept_no", "updated_at")
    out = state.upsert(state.upsert(None, early), late)
    return out.select("rcept_no", "event_type", F.col("updated_at.event_id").alias("event_id"), F.col("first_seen_at.event_id").alias("first_event_id"))


QUERIES = {
    f.__name__: f
    for f in (
        src5_date_windows, src6_from_listing, agg2_receipts_last_wins, src7_structured_rows, cls1_taxonomy, flt6_unlisted, flt7_other, fn8_parse_number, fn14_prefix, fn_scalars,
        prj5_dispatch, jn2_structured_match, jn3_cluster, jn4_merge, jn1_seen_anti, scr1_scores, flt8_band, srt1_rank, src3_adapter, agg7_counters, agg10_related_categories,
        src10_rows, fn20_phrases, fn21_snapshot, snk1_upsert,
    )
} | {
    "prj6_acquisition_facts": _facts("acquisition", "target_name", "acquisition_amount", "asset_ratio_pct", "post_stake_pct", "put_option", "control_acquisition", "new_business_language", "debt_like_payment"),
    "prj7_bond_facts": _facts("cb", "instrument", "issue_amount", "conversion_or_exercise_price", "dilution_ratio_pct", "funds_debt_repayment"),
    "prj7_warrant_facts": _facts("bw", "instrument", "issue_amount", "conversion_or_exercise_price", "dilution_ratio_pct", "funds_debt_repayment"),
    "prj8_equity_facts": _facts("equity_issuance", "new_shares", "existing_shares_before", "dilution_ratio_pct", "issue_method"),
}

# ---- the same in DuckDB SQL ----
_V = with_views("disclosures_v")
_q = lambda s: "'" + s + "'"


def _any(x: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(t)})" for t in tokens) + ")"


def _case(pick, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any('cn', r.tokens)} THEN {pick(r)}" for r in taxonomy.RULES) + f" ELSE {other} END"


_ACQ = f"contains(cn, {_q(taxonomy.ACQUISITION_ROWS)})"
_kind = lambda r: "NULL" if r.kind is None else f"CASE WHEN {_ACQ} THEN 'acquisition' END" if r.kind == "acquisition" else _q(r.kind)
_needs = lambda r: f"NOT {_ACQ}" if r.kind == "acquisition" else str(r.needs_document).lower()
_PRE = r"regexp_extract(trim(report_nm), '^(\[[^\]]+\]\s*)+')"
_NAME = r"trim(regexp_replace(trim(report_nm), '^(\[[^\]]+\]\s*)+', ''))"
_CLS = _V + rf""", nm AS (SELECT *, regexp_replace({_NAME}, '[\sㆍ·・\-_/]', '', 'g') AS cn FROM disclosures_v),
cl AS (SELECT *, {_case(lambda r: _q(r.category), "'other'")} AS category, {_case(lambda r: _q(r.subtype), "'other'")} AS subtype, {_case(lambda r: str(r.base), "0")} AS base,
  {_case(_kind, "NULL")} AS kind, {_case(_needs, "false")} AS needs, {_case(lambda r: _q(",".join(r.tags)), "''")} AS tags, {_any(_PRE, S.CORRECTIONS)} AS corr,
  CAST(substr(rcept_no, 9) AS BIGINT) AS n FROM nm),
ev AS (SELECT *, post_stake_pct >= 50 OR {_any('purpose', facts.CONTROL_WORDS)} AS control, {_any('purpose', facts.NEW_BUSINESS_WORDS)} AS newb, {_any('payment_terms', facts.DEBT_WORDS)} AS debt,
  n % 3 = 0 AS phr, category = 'portfolio_pivot' AND (subtype <> 'shareholder_meeting_agenda' OR n % 3 = 0) AS piv FROM cl WHERE stock_code <> '' AND category <> 'other')"""
_NEAR = "b.corp_code = a.corp_code AND b.rcept_date BETWEEN a.rcept_date - INTERVAL 30 DAY AND a.rcept_date AND b.rcept_no <> a.rcept_no"
_BEFORE = "(b.rcept_dt, b.rcept_no) < (a.rcept_dt, a.rcept_no)"
_REL = _CLS + f""", rl AS (SELECT a.rcept_no, b.rcept_no AS r, b.rcept_dt AS rd, b.category AS c, b.piv AS p FROM ev a JOIN ev b ON {_NEAR} AND {_BEFORE}),
rs AS (SELECT rcept_no, bool_or(c = 'acquisition_control') AS m_acq, bool_or(c = 'financing_dilution') AS m_fin, bool_or(c = 'governance_change') AS m_gov, bool_or(p) AS m_piv FROM rl GROUP BY rcept_no)"""


def _lad(x: str, levels) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} THEN {p}" for a, p in levels) + " ELSE 0 END"


_DR = _lad("dilution_ratio_pct", risk.DILUTION_LEVELS)
#: condition, attention, risk, has a reason, has a risk reason, tag: in the order of the rules.
_RULES = (
    ("base > 0", "base", "0", 1, 0, None), ("corr", "0", "0", 1, 0, None), ("acq AND control", "20", "0", 1, 0, None),
    ("acq AND asset_ratio_pct >= 10", _lad("asset_ratio_pct", risk.ASSET_LEVELS), "0", 1, 0, None), ("acq AND asset_ratio_pct >= 50", "0", _lad("asset_ratio_pct", risk.HEAVY_LEVELS), 0, 1, None),
    ("acq AND equity_ratio_pct >= 20", _lad("equity_ratio_pct", risk.EQUITY_LEVELS), "0", 1, 0, None), ("acq AND equity_ratio_pct >= 50", "0", _lad("equity_ratio_pct", risk.HEAVY_LEVELS), 0, 1, None),
    ("acq AND newb", "8", "0", 1, 0, None), ("acq AND debt", "0", "15", 0, 1, None), (f"fin AND {_DR} > 0", f"least({_DR} * 0.25, 10)", _DR, 1, 1, None),
    ("fin AND funds_debt_repayment > 0", "0", "10", 0, 1, None), ("fin AND (contains(issue_method, '제3자') OR contains(issue_method, '사모'))", "0", "5", 0, 1, None),
    ("category = 'portfolio_pivot' AND phr AND subtype = 'shareholder_meeting_agenda'", "35", "0", 1, 0, None), ("category = 'portfolio_pivot' AND phr AND subtype <> 'shareholder_meeting_agenda'", "15", "0", 1, 0, None),
    ("exe AND m_acq", "20", "0", 1, 0, "execution_confirmation"), ("exe AND NOT m_acq AND m_piv", "12", "0", 1, 0, "pivot_confirmation"),
    ("(acq AND m_fin) OR (fin AND m_acq)", "10", "20", 1, 1, "leveraged_transformation"), ("(acq AND m_piv) OR (piv AND m_acq)", "10", "0", 1, 0, "portfolio_pivot_confirmation"),
    ("(category = 'governance_change' AND m_acq) OR (acq AND m_gov)", "8", "5", 1, 1, "governance_transition"),
)
_sum = lambda k: " + ".join(f"CASE WHEN {r[0]} THEN {r[k]} ELSE 0 END" for r in _RULES if r[k] not in ("0", 0))
_SC = _REL + f""", jo AS (SELECT ev.*, coalesce(m_acq, false) AS m_acq, coalesce(m_fin, false) AS m_fin, coalesce(m_gov, false) AS m_gov, coalesce(m_piv, false) AS m_piv,
  category = 'acquisition_control' AS acq, category = 'financing_dilution' AS fin, category = 'execution_validation' AS exe FROM ev LEFT JOIN rs USING (rcept_no)),
sc AS (SELECT *, CAST(least({_sum(1)}, 100) AS DOUBLE) AS att, CAST(least({_sum(2)}, 100) AS DOUBLE) AS rsk, {_sum(3)} AS nr, {_sum(4)} AS nk,
  concat_ws(',', {", ".join(f"CASE WHEN {r[0]} THEN '{r[5]}' END" for r in _RULES if r[5])}) AS ct FROM jo),
sb AS (SELECT *, CASE WHEN att >= 75 THEN 'urgent' WHEN att >= 55 THEN 'review' WHEN att >= 35 THEN 'watch' ELSE 'low' END AS band FROM sc)"""
_ORD = "att DESC, rsk DESC, rcept_dt DESC, rcept_no DESC"
_ST = _CLS + ", st AS (SELECT * FROM cl WHERE kind IS NOT NULL AND substr(rcept_no, 14, 1) <> '7')"
_D = "CASE WHEN n % 100 >= 50 THEN true ELSE " + _any("purpose", facts.CONTROL_WORDS) + " END"
_MK = "WITH p AS (SELECT p_partkey AS k, p_name || ' | ' || p_partkey AS r1, '매출액 | - | ' || format('{:,}', p_partkey * 1000) || '원' AS r3, '자산 총계 | ' || CASE WHEN p_partkey % 3 = 0 THEN '없음' ELSE CAST(p_partkey AS VARCHAR) END AS r4 FROM part)"
ORACLES = {
    "src5_date_windows": "SELECT strftime(d, '%Y%m%d') AS window_start, strftime(least(d + INTERVAL 79 DAY, DATE '2024-12-31'), '%Y%m%d') AS window_end FROM range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 80 DAY) t(d)",
    "src6_from_listing": "SELECT 'Y' AS corp_cls, trim(c_name) AS corp_name, '' AS corp_code, '' AS stock_code, '' AS report_nm, CAST(c_custkey AS VARCHAR) AS rcept_no, '' AS flr_nm, '' AS rcept_dt, '' AS rm FROM customer WHERE c_custkey % 7 <> 0",
    "agg2_receipts_last_wins": "SELECT CAST(user_id AS VARCHAR) AS rcept_no, arg_max(event_type, event_id) AS report_nm FROM events GROUP BY user_id",
    "src7_structured_rows": _CLS + " SELECT rcept_no, rcept_dt FROM cl WHERE kind = 'cb' AND corp_code = '00000301' AND rcept_dt BETWEEN '19920101' AND '19991231'",
    "cls1_taxonomy": _CLS + " SELECT rcept_no, category, subtype, CAST(base AS INTEGER) AS base_attention, kind AS structured_kind, needs AS requires_document, corr AS is_correction, tags FROM cl",
    "flt6_unlisted": _V + " SELECT rcept_no FROM disclosures_v WHERE stock_code <> ''",
    "flt7_other": _CLS + " SELECT rcept_no FROM cl WHERE category <> 'other'",
    "fn8_parse_number": with_views("comma_numbers_v") + r" SELECT k, CASE WHEN raw IN ('-', '없음') THEN NULL ELSE try_cast(replace(regexp_extract(regexp_replace(raw, '[원주%]', '', 'g'), '[-+]?\d[\d,]*(\.\d+)?'), ',', '') AS DOUBLE) END AS number FROM comma_numbers_v",
    "fn14_prefix": _V + rf" SELECT rcept_no, {_NAME} AS name, {_any(_PRE, S.CORRECTIONS)} AS corrected, regexp_replace({_NAME}, '[\sㆍ·・\-_/]', '', 'g') AS compact_name, regexp_replace(report_nm, '[\sㆍ·・\-_/()]', '', 'g') AS compact_cell FROM disclosures_v",
    "fn_scalars": """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS v, o_orderstatus AS s, o_orderdate AS d FROM orders),
b AS (SELECT *, CASE WHEN v >= 75 THEN 'urgent' WHEN v >= 55 THEN 'review' WHEN v >= 35 THEN 'watch' ELSE 'low' END AS band FROM o)
SELECT o_orderkey, round(least(greatest(v / 400, 0), 1), 9) AS unit, band, CASE band WHEN 'low' THEN 0 WHEN 'watch' THEN 1 WHEN 'review' THEN 2 ELSE 3 END AS band_rank,
CAST(CASE WHEN v >= 100 THEN 20 WHEN v >= 50 THEN 15 WHEN v >= 20 THEN 10 WHEN v >= 10 THEN 5 ELSE 0 END AS DOUBLE) AS points, s || '|b' AS csv,
strftime(CAST(d AS DATE) - 30, '%Y%m%d') AS earlier, 'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || strftime(d, '%Y%m%d') AS url, round(v / nullif(v - floor(v / 7) * 7, 0) * 100, 6) AS ratio,
CASE WHEN floor(v % 3) = 0 AND floor(v % 2) = 0 THEN NULL ELSE floor(v % 3) + floor(v % 2) END AS sum, least(greatest(floor(v), 0), 100) AS clamped,
greatest(floor(v % 5) - 2, 0) + greatest(floor(v % 7) - 3, 0) AS positive FROM b""",
    "prj6_acquisition_facts": _ST + f" SELECT rcept_no, 'target ' || n AS target_name, CAST(n * 1000 AS DOUBLE) AS acquisition_amount, n % 160 + 0.5::DOUBLE AS asset_ratio_pct, CAST(n % 100 AS DOUBLE) AS post_stake_pct, '-' AS put_option, {_D} AS control_acquisition, true AS new_business_language, {_any('payment_terms', facts.DEBT_WORDS)} AS debt_like_payment FROM st WHERE kind = 'acquisition'",
    "prj7_bond_facts": _ST + " SELECT rcept_no, 'CB' AS instrument, CAST(n * 100 AS DOUBLE) AS issue_amount, CAST(n * 3 AS DOUBLE) AS conversion_or_exercise_price, 24.35::DOUBLE AS dilution_ratio_pct, CAST(n * 7 AS DOUBLE) AS funds_debt_repayment FROM st WHERE kind = 'cb'",
    "prj7_warrant_facts": _ST + " SELECT rcept_no, 'BW' AS instrument, CAST(n * 100 AS DOUBLE) AS issue_amount, CAST(n * 4 AS DOUBLE) AS conversion_or_exercise_price, CAST(NULL AS DOUBLE) AS dilution_ratio_pct, CAST(n * 7 AS DOUBLE) AS funds_debt_repayment FROM st WHERE kind = 'bw'",
    "prj8_equity_facts": _ST + " SELECT rcept_no, CAST(n * 2 AS DOUBLE) AS new_shares, CAST(n * 8 AS DOUBLE) AS existing_shares_before, 25.0::DOUBLE AS dilution_ratio_pct, issue_method FROM st WHERE kind = 'equity_issuance'",
    "prj5_dispatch": _ST + " SELECT rcept_no, kind AS structured_kind, CASE kind WHEN 'cb' THEN 'CB' WHEN 'bw' THEN 'BW' WHEN 'equity_issuance' THEN 'paid_in_capital_increase' END AS instrument, CASE kind WHEN 'cb' THEN 24.35::DOUBLE WHEN 'equity_issuance' THEN 25.0 END AS dilution_ratio_pct, CASE WHEN kind <> 'acquisition' THEN issue_method END AS issue_method FROM st",
    "jn2_structured_match": _CLS + " SELECT rcept_no, CASE WHEN kind IS NOT NULL AND substr(rcept_no, 14, 1) <> '7' AND (kind <> 'cb' OR corr) THEN n END AS matched_ord, kind IS NOT NULL AND NOT (substr(rcept_no, 14, 1) <> '7' AND (kind <> 'cb' OR corr)) AS warned FROM cl",
    "jn3_cluster": _REL + " SELECT ev.rcept_no, coalesce(string_agg(r, ',' ORDER BY rd, r), '') AS related FROM ev LEFT JOIN rl USING (rcept_no) GROUP BY ev.rcept_no",
    "jn4_merge": _CLS + f", rl AS (SELECT a.rcept_no, b.rcept_no AS r, b.rcept_dt AS rd, b.n % 3 = 0 AS st FROM ev a JOIN ev b ON {_NEAR} AND (b.n % 3 = 0 OR {_BEFORE})) SELECT ev.rcept_no, coalesce(string_agg(r, ',' ORDER BY st DESC, rd, r), '') AS related FROM ev LEFT JOIN rl USING (rcept_no) GROUP BY ev.rcept_no",
    "jn1_seen_anti": _CLS + " SELECT rcept_no FROM ev WHERE n % 10 <> 0",
    "scr1_scores": _SC + " SELECT rcept_no, att AS attention_score, rsk AS financing_risk_score, band, ct AS cluster_tags, CAST(nr AS INTEGER) AS n_reasons, CAST(nk AS INTEGER) AS n_risk_reasons FROM sb",
    "flt8_band": _SC + " SELECT rcept_no, band FROM sb WHERE band IN ('review', 'urgent')",
    "srt1_rank": _SC + f" SELECT rcept_no, CAST(row_number() OVER (ORDER BY {_ORD}) AS INTEGER) AS rank FROM sb QUALIFY rank <= 50",
    "src3_adapter": _SC + f" SELECT 'dart:' || rcept_no AS candidate_id, 'corp ' || corp_code || ' — ' || report_nm AS title, att AS attention_score, concat_ws(',', category, band, nullif(ct, '')) AS tags, row_number() OVER (ORDER BY {_ORD}) AS ord FROM sb",
    "agg7_counters": _CLS + " SELECT (SELECT count(*) FROM cl) AS total_disclosures, (SELECT count(*) FROM ev) AS classified_disclosures, (SELECT count(*) FROM ev WHERE n % 10 = 0) AS skipped_seen, (SELECT count(*) FROM cl WHERE stock_code = '') AS skipped_unlisted",
    "agg10_related_categories": _REL + " SELECT rcept_no, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM rl GROUP BY rcept_no",
    "src10_rows": r"SELECT page_id, 1 AS n_rows, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS cell FROM pages",
    "fn20_phrases": _MK + " SELECT k AS id, CASE WHEN k % 2 = 0 THEN '제2호 신규 사업 | 정관 변경 // ' || r3 || ' // ' || r4 ELSE '' END AS phrases FROM p",
    "fn21_snapshot": _MK + " SELECT k AS id, CAST(k * 1000 AS DOUBLE) AS revenue, CASE WHEN k % 3 = 0 THEN 7.0::DOUBLE ELSE CAST(k AS DOUBLE) END AS assets, CAST(NULL AS DOUBLE) AS equity FROM p",
    "snk1_upsert": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS rcept_no, event_type, ts, event_id, event_id % 2 AS odd FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY rcept_no, odd ORDER BY ts DESC, event_id DESC) = 1)
SELECT rcept_no, event_type, event_id, first_value(event_id) OVER (PARTITION BY rcept_no ORDER BY ts, event_id) AS first_event_id FROM l
QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY odd DESC) = 1""",
}
