"""Facts of structured filings: one projection for each kind, and the exact-receipt match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Fact name to source field; numbers and texts.
ACQUISITION = {
    "target_name": "iscmp_cmpnm", "target_country": "iscmp_nt", "target_business": "iscmp_mbsn", "purpose": "inh_pp",
    "payment_terms": "dl_pym", "scheduled_date": "inh_prd", "counterparty": "dlptn_cmpnm", "external_valuation": "exevl_atn",
    "external_valuation_opinion": "exevl_op", "put_option": "popt_ctr_atn", "put_option_terms": "popt_ctr_cn",
}
ACQUISITION_NUMBERS = {
    "acquisition_amount": "inhdtl_inhprc", "acquirer_total_assets": "inhdtl_tast", "asset_ratio_pct": "inhdtl_tast_vs",
    "acquirer_equity": "inhdtl_ecpt", "equity_ratio_pct": "inhdtl_ecpt_vs", "post_stake_pct": "atinh_eqrt",
}
FUNDS = {
    "funds_facility": "fdpp_fclt", "funds_business_acquisition": "fdpp_bsninh", "funds_operations": "fdpp_op",
    "funds_debt_repayment": "fdpp_dtrp", "funds_other_company_securities": "fdpp_ocsa", "funds_other": "fdpp_etc",
}
BOND = {"round": "bd_tm", "maturity_date": "bd_mtd", "issue_method": "bdis_mthn", "payment_date": "pymd"}
BOND_NUMBERS = {"issue_amount": "bd_fta", "coupon_rate_pct": "bd_intr_ex", "yield_to_maturity_pct": "bd_intr_sf", "reset_floor_price": "act_mktprcfl_cvprc_lwtrsprc"}
#: Fields that differ by kind, (convertible bond, bond with warrants).
BOND_SWAPS = {
    "conversion_or_exercise_price": ("cv_prc", "ex_prc"),
    "dilution_shares": ("cvisstk_cnt", "nstk_isstk_cnt"),
    "dilution_ratio_pct": ("cvisstk_tisstk_vs", "nstk_isstk_tisstk_vs"),
}
CONTROL_WORDS = ("경영권", "지배력", "최대주주", "종속회사")
NEW_BUSINESS_WORDS = ("신규사업", "사업다각화", "신성장", "사업영역 확대", "포트폴리오")
DEBT_WORDS = ("차입", "대출", "전환사채", "신주인수권부사채", "교환사채", "사채", "인수금융")
KINDS = ("acquisition", "cb", "bw", "equity_issuance")


def _reader(rows: DataFrame):
    """Fields by name; an absent one is null."""
    have = set(rows.columns)
    raw = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    return (lambda c: S.text(raw(c))), (lambda c: S.parse_number(raw(c)))


def flags(post_stake: Column, purpose: Column, target_business: Column, payment: Column) -> dict[str, Column]:
    return {
        "control_acquisition": F.coalesce(post_stake >= 50, F.lit(False)) | S.contains_any(purpose, CONTROL_WORDS),
        "new_business_language": S.contains_any(F.concat_ws(" ", purpose, target_business), NEW_BUSINESS_WORDS),
        "debt_like_payment": S.contains_any(payment, DEBT_WORDS),
    }


def acquisition_facts(rows: DataFrame, *keys: str) -> DataFrame:
    text, number = _reader(rows)
    facts = {k: text(c) for k, c in ACQUISITION.items()} | {k: number(c) for k, c in ACQUISITION_NUMBERS.items()}
    facts |= flags(facts["post_stake_pct"], facts["purpose"], facts["target_business"], facts["payment_terms"])
    return rows.select(*keys, F.lit("acquisition").alias("structured_kind"), *(v.alias(k) for k, v in facts.items()))


def bond_facts(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    text, number = _reader(rows)
    at = 0 if kind == "cb" else 1
    facts = {k: text(c) for k, c in BOND.items()} | {k: number(c) for k, c in (BOND_NUMBERS | FUNDS).items()}
    facts |= {k: number(c[at]) for k, c in BOND_SWAPS.items()}
    return rows.select(*keys, F.lit(kind).alias("structured_kind"), F.lit(kind.upper()).alias("instrument"), *(v.alias(k) for k, v in facts.items()))


def equity_facts(rows: DataFrame, *keys: str) -> DataFrame:
    text, number = _reader(rows)
    new = S.sum_or_null(number("nstk_ostk_cnt"), number("nstk_estk_cnt"))
    old = S.sum_or_null(number("bfic_tisstk_ostk"), number("bfic_tisstk_estk"))
    facts = {"new_shares": new, "existing_shares_before": old, "dilution_ratio_pct": S.ratio(new, old), "issue_method": text("ic_mthn")}
    facts |= {k: number(c) for k, c in FUNDS.items()}
    return rows.select(*keys, F.lit("equity_issuance").alias("structured_kind"), F.lit("paid_in_capital_increase").alias("instrument"), *(v.alias(k) for k, v in facts.items()))


def normalise(rows_by_kind: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Facts of all kinds in one table; a kind without a builder keeps its row as JSON."""
    parts = []
    for kind, rows in rows_by_kind.items():
        if kind == "acquisition":
            parts.append(acquisition_facts(rows, *keys))
        elif kind in ("cb", "bw"):
            parts.append(bond_facts(rows, kind, *keys))
        elif kind == "equity_issuance":
            parts.append(equity_facts(rows, *keys))
        else:
            parts.append(rows.select(*keys, F.lit(kind).alias("structured_kind"), F.to_json(F.struct(*rows.columns)).alias("raw_structured")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def match_structured(filings: DataFrame, rows: DataFrame, fallback_days: int = 400, order: str = "ord") -> DataFrame:
    """Left join on the exact receipt number within company and kind: the first row
    by ``order`` filed on the filing's day, for corrections also within the days
    before. ``rows`` has structured_kind, corp_code, rcept_no, rcept_dt and its own
    columns, which come back under ``matched`` (null without a match)."""
    right = rows.select(
        F.col("structured_kind").alias("sw_k"), F.col("corp_code").alias("sw_c"), S.text(F.col("rcept_no")).alias("sw_r"),
        S.ymd(F.col("rcept_dt")).alias("sw_d"), F.col(order).alias("sw_o"), F.struct(*rows.columns).alias("matched"),
    )
    day = S.ymd(F.col("rcept_dt"))
    on = (F.col("structured_kind") == F.col("sw_k")) & (F.col("corp_code") == F.col("sw_c")) & (S.text(F.col("rcept_no")) == F.col("sw_r"))
    early = F.when(F.coalesce("is_correction", F.lit(False)), F.date_sub(day, fallback_days)).otherwise(day)
    on = on & (F.col("sw_d") <= day) & (F.col("sw_d") >= early)
    joined = filings.join(right, on, "left")
    # Own-day rows come before those of the wider search.
    first = Window.partitionBy("corp_code", "rcept_no").orderBy((F.col("sw_d") == day).desc_nulls_last(), "sw_o")
    best = joined.withColumn("sw_n", F.row_number().over(first)).where("sw_n = 1")
    return best.select(*filings.columns, "matched")


def match_warning(matched: DataFrame) -> Column:
    """The warning of a filing whose structured row wasn't found; null otherwise."""
    said = F.concat(F.lit("접수번호와 일치하는 "), F.col("structured_kind"), F.lit(" 구조화 행을 찾지 못함"))
    return F.when(F.col("structured_kind").isNotNull() & F.col("matched").isNull(), said)
