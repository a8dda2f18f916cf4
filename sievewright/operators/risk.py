"""Attention and financing-risk scores of classified filings.

Every rule is a pair of point columns and texts; scores never feed into other rows,
so scoring is one projection after the clustering join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Ladders of (threshold, points).
ASSET_LEVELS = ((100, 20), (50, 15), (20, 10), (10, 5))
EQUITY_LEVELS = ((100, 15), (50, 10), (20, 5))
HEAVY_LEVELS = ((100, 20), (50, 12))
DILUTION_LEVELS = ((50, 40), (30, 30), (15, 20), (5, 10))
NO_PUT_OPTION = ("", "-", "N", "부", "아니오", "미해당", "해당없음", "없음")
PRIVATE_METHODS = ("제3자", "사모")
#: Texts of reasons and risk reasons; {} takes a number or text.
SAID = {
    "base": "{} 기본 주목도 {}점",
    "correction": "정정·조건확정 공시이므로 기존 사건의 가정 변경 여부를 확인해야 함",
    "control": "경영권 또는 지배력 확보가 수반되는 인수",
    "asset": "인수금액이 총자산의 {}%",
    "asset_risk": "총자산 대비 인수 규모가 {}%로 큼",
    "equity": "인수금액이 자기자본의 {}%",
    "equity_risk": "자기자본 대비 인수 규모가 {}%로 큼",
    "new_business": "신규사업·사업다각화 목적이 명시됨",
    "target": "인수대상 주요사업이 구조화 공시에 명시됨",
    "debt": "거래대금 지급에 차입·사채·인수금융 표현이 포함됨",
    "put": "풋옵션 등 추가 계약조건이 존재할 수 있음",
    "dilution": "대규모 자금조달은 변신 거래의 크기를 보여주는 보조 신호",
    "dilution_risk": "잠재 희석률이 {}%",
    "funding": "자금 사용 목적에 영업양수·타법인 증권 취득이 포함됨",
    "repayment": "조달자금 일부가 채무상환에 사용됨",
    "method": "발행방법이 {}",
    "agenda": "주총 안건 원문에서 사업목적·신규사업 관련 문구를 확인",
    "phrases": "원문에서 사업목적·신규사업 관련 문구를 확인",
    "snapshot": "원문에서 재무수치 후보를 추출해 후속 검증 가능",
    "after_acquisition": "최근 인수 이후 공급계약·상업화 증거가 이어짐",
    "after_pivot": "최근 사업전환 공시 이후 실행 증거가 이어짐",
    "leveraged": "30일 내 인수와 자금조달 공시가 결합됨",
    "leveraged_risk": "레버리지·메자닌을 동반한 변신 거래일 가능성",
    "scope": "인수와 사업범위 변경이 함께 나타남",
    "governance": "경영권·대표 변경이 인수 사건과 인접",
    "governance_risk": "거버넌스 재편이 동시에 진행됨",
}
#: Facts that scoring reads; absent columns count as null.
FACTS = {
    "control_acquisition": "boolean", "asset_ratio_pct": "double", "equity_ratio_pct": "double", "new_business_language": "boolean",
    "target_business": "string", "debt_like_payment": "boolean", "put_option": "string", "dilution_ratio_pct": "double",
    "funds_business_acquisition": "double", "funds_other_company_securities": "double", "funds_debt_repayment": "double",
    "issue_method": "string", "business_purpose_phrases": "array<string>", "document_financial_snapshot": "map<string,double>",
}


def _say(name: str, *values: Column) -> Column:
    parts = SAID[name].split("{}")
    pieces = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        pieces += [value, F.lit(rest)]
    return F.concat(*pieces)


def confirmed_pivot(category: Column, subtype: Column, phrases: Column) -> Column:
    """A pivot counts unless it is a meeting agenda without purpose phrases."""
    return (category == "portfolio_pivot") & ((subtype != "shareholder_meeting_agenda") | F.coalesce(F.size(phrases) > 0, F.lit(False)))


def with_facts(rows: DataFrame) -> DataFrame:
    """Add the fact columns that are missing, and confirmed_pivot."""
    have = set(rows.columns)
    rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in FACTS.items() if k not in have})
    return rows.withColumn("confirmed_pivot", confirmed_pivot(F.col("category"), F.col("subtype"), F.col("business_purpose_phrases")))


def score_filings(rows: DataFrame) -> DataFrame:
    """Classified filings with facts and ``related`` events: attention_score,
    financing_risk_score, band, reasons, risk_reasons, cluster_tags, related_receipts."""
    rows = with_facts(rows) if "confirmed_pivot" not in rows.columns else rows
    category = F.col("category")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = lambda x: S.fixed(x, 1)
    acq, fin = category == "acquisition_control", category == "financing_dilution"
    pivot, execution, governance = category == "portfolio_pivot", category == "execution_validation", category == "governance_change"
    met = lambda name: F.exists("related", lambda e: e["category"] == name)
    met_pivot = F.exists("related", lambda e: F.coalesce(e["confirmed_pivot"], F.lit(False)))
    met_acq, met_fin, met_gov = met("acquisition_control"), met("financing_dilution"), met("governance_change")
    asset, equity, dilution = F.col("asset_ratio_pct"), F.col("equity_ratio_pct"), F.col("dilution_ratio_pct")
    phrases = F.coalesce(F.size("business_purpose_phrases") > 0, F.lit(False))
    agenda = F.col("subtype") == "shareholder_meeting_agenda"
    dilution_risk = S.ladder(dilution, DILUTION_LEVELS)
    funding = S.positive_sum(F.col("funds_business_acquisition"), F.col("funds_other_company_securities")) > 0
    method = F.coalesce("issue_method", F.lit(""))
    leveraged = (acq & met_fin) | (fin & met_acq)
    scope = (acq & met_pivot) | (yes("confirmed_pivot") & met_acq)
    reorganised = (governance & met_acq) | (acq & met_gov)
    # condition, attention, risk, reason, risk reason, tag
    rules = (
        (F.col("base_attention") > 0, F.col("base_attention"), 0, _say("base", F.concat_ws("/", category, "subtype"), F.col("base_attention").cast("string")), None, None),
        (yes("is_correction"), 0, 0, _say("correction"), None, None),
        (acq & yes("control_acquisition"), 20, 0, _say("control"), None, None),
        (acq & (asset >= 10), S.ladder(asset, ASSET_LEVELS), 0, _say("asset", one(asset)), None, None),
        (acq & (asset >= 50), 0, S.ladder(asset, HEAVY_LEVELS), None, _say("asset_risk", one(asset)), None),
        (acq & (equity >= 20), S.ladder(equity, EQUITY_LEVELS), 0, _say("equity", one(equity)), None, None),
        (acq & (equity >= 50), 0, S.ladder(equity, HEAVY_LEVELS), None, _say("equity_risk", one(equity)), None),
        (acq & yes("new_business_language"), 8, 0, _say("new_business"), None, None),
        (acq & (S.text(F.col("target_business")) != ""), 2, 0, _say("target"), None, None),
        (acq & yes("debt_like_payment"), 0, 15, None, _say("debt"), None),
        (acq & ~S.text(F.col("put_option")).isin(*NO_PUT_OPTION), 0, 5, None, _say("put"), None),
        (fin & (dilution_risk > 0), F.least(dilution_risk * 0.25, F.lit(10.0)), dilution_risk, _say("dilution"), _say("dilution_risk", one(dilution)), None),
        (fin & funding, 15, 0, _say("funding"), None, "transformation_financing"),
        (fin & (F.col("funds_debt_repayment") > 0), 0, 10, None, _say("repayment"), None),
        (fin & S.contains_any(method, PRIVATE_METHODS), 0, 5, None, _say("method", method), None),
        (pivot & phrases & agenda, 35, 0, _say("agenda"), None, None),
        (pivot & phrases & ~agenda, 15, 0, _say("phrases"), None, None),
        (pivot & (F.size("document_financial_snapshot") > 0), 3, 0, _say("snapshot"), None, None),
        (execution & met_acq, 20, 0, _say("after_acquisition"), None, "execution_confirmation"),
        (execution & ~met_acq & met_pivot, 12, 0, _say("after_pivot"), None, "pivot_confirmation"),
        (leveraged, 10, 20, _say("leveraged"), _say("leveraged_risk"), "leveraged_transformation"),
        (scope, 10, 0, _say("scope"), None, "portfolio_pivot_confirmation"),
        (reorganised, 8, 5, _say("governance"), _say("governance_risk"), "governance_transition"),
    )
    held = {f"sw_r{i}": F.coalesce(r[0], F.lit(False)) for i, r in enumerate(rules)}
    rows = rows.withColumns(held)
    when = lambda i, v: F.when(F.col(f"sw_r{i}"), v)
    total = lambda k: sum((when(i, r[k] if isinstance(r[k], Column) else F.lit(r[k])).otherwise(0).cast("double") for i, r in enumerate(rules) if not (isinstance(r[k], int) and r[k] == 0)), F.lit(0.0))
    texts = lambda k: F.array_compact(F.array(*(when(i, r[k] if isinstance(r[k], Column) else F.lit(r[k])) for i, r in enumerate(rules) if r[k] is not None)))
    attention = S.clamp_score(total(1))
    rows = rows.withColumns({
        "attention_score": attention, "financing_risk_score": S.clamp_score(total(2)), "band": S.band(attention),
        "reasons": texts(3), "risk_reasons": texts(4), "cluster_tags": F.array_distinct(texts(5)),
        "related_receipts": F.transform("related", lambda e: e["rcept_no"]),
    })
    return rows.drop(*held)


def ranked(scored: DataFrame) -> DataFrame:
    """Best first by attention, risk, date and receipt."""
    return scored.orderBy(*(F.col(c).desc() for c in ("attention_score", "financing_risk_score", "rcept_dt", "rcept_no")))
