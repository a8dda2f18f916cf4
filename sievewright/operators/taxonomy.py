"""Ordered first-match taxonomy of corporate filings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    category: str
    subtype: str
    base: int
    kind: str | None
    needs_document: bool
    tags: tuple[str, ...]


#: Fixed values; the order is part of the meaning.
RULES = (
    Rule(("타법인주식및출자증권양수결정", "타법인주식및출자증권취득결정", "영업양수결정", "최대주주변경을수반하는주식양수도계약체결"),
         "acquisition_control", "equity_or_business_acquisition", 25, "acquisition", True, ("transformation_core", "control_change_candidate")),
    Rule(("회사합병결정", "회사분할합병결정", "회사분할결정", "주식교환이전결정", "주식의포괄적교환이전"),
         "merger_reorganization", "merger_or_reorganization", 40, None, True, ("transformation_core",)),
    Rule(("타법인주식및출자증권양도결정", "영업양도결정", "유형자산양도결정"),
         "divestiture", "business_or_asset_divestiture", 20, None, True, ("portfolio_change",)),
    Rule(("전환사채권발행결정",), "financing_dilution", "convertible_bond", 5, "cb", False, ("dilution", "financing")),
    Rule(("신주인수권부사채권발행결정",), "financing_dilution", "bond_with_warrants", 5, "bw", False, ("dilution", "financing")),
    Rule(("교환사채권발행결정",), "financing_dilution", "exchangeable_bond", 4, None, True, ("financing",)),
    Rule(("유상증자결정", "유무상증자결정"), "financing_dilution", "paid_in_capital_increase", 5, "equity_issuance", False, ("dilution", "financing")),
    Rule(("단기차입금증가결정", "장기차입금증가결정", "채무보증결정", "담보제공결정", "금전대여결정"),
         "financing_dilution", "debt_or_guarantee", 4, None, True, ("financing", "balance_sheet_risk")),
    Rule(("사업목적추가", "정관변경", "신규시설투자", "시설투자", "생산시설증설", "유형자산양수결정", "신규사업진출"),
         "portfolio_pivot", "business_scope_or_capacity_change", 28, None, True, ("portfolio_change",)),
    Rule(("주주총회소집공고", "주주총회소집결의"), "portfolio_pivot", "shareholder_meeting_agenda", 0, None, True, ("agenda_scan",)),
    Rule(("단일판매공급계약체결", "공급계약체결", "기술이전계약", "공동개발계약", "수주계약", "투자판단관련주요경영사항"),
         "execution_validation", "commercial_validation", 18, None, True, ("execution_evidence",)),
    Rule(("최대주주변경", "대표이사변경", "경영권변경"), "governance_change", "control_or_management_change", 12, None, True, ("governance",)),
)
#: Fixed value: only names with this part have structured acquisition rows.
ACQUISITION_ROWS = "타법인주식및출자증권"


def rule_index(compact_name: Column) -> Column:
    """The first matching rule's index; the number of rules if none matches. The rules
    are one folded literal: as 46 separate tests they would outgrow a generated method.
    The name is bound first, so that its making isn't repeated for every token."""
    rules = F.array(*(F.array(*map(F.lit, r.tokens)) for r in RULES))

    def index(name: Column) -> Column:
        hits = F.transform(rules, lambda tokens: F.exists(tokens, lambda t: name.contains(t)))
        return F.coalesce(F.nullif(F.array_position(hits, True), F.lit(0)) - 1, F.lit(len(RULES))).cast("int")

    return F.transform(F.array(compact_name), index)[0]


def classify(filings: DataFrame, name: str = "report_nm") -> DataFrame:
    """Filings with category, subtype, base_attention, structured_kind,
    requires_document, tags, is_correction and normalized_report_name."""
    rows = filings.withColumn("sw_name", S.compact_name(F.col(name)))
    rows = rows.select("*", rule_index(F.col("sw_name")).alias("sw_i"), F.col("sw_name").contains(ACQUISITION_ROWS).alias("sw_rows"))
    all_rules = (*RULES, Rule((), "other", "other", 0, None, False, ()))

    def pick(values) -> Column:
        """The rule's entry of a literal list."""
        return F.array(*values)[F.col("sw_i")]

    is_acquisition = F.col("sw_i") == 0
    kind = F.when(is_acquisition, F.when(F.col("sw_rows"), "acquisition")).otherwise(pick(F.lit(r.kind).cast("string") for r in all_rules))
    needs = F.when(is_acquisition, ~F.col("sw_rows")).otherwise(pick(F.lit(r.needs_document) for r in all_rules))
    return rows.select(
        *filings.columns,
        pick(F.lit(r.category) for r in all_rules).alias("category"),
        pick(F.lit(r.subtype) for r in all_rules).alias("subtype"),
        pick(F.lit(r.base) for r in all_rules).alias("base_attention"),
        kind.alias("structured_kind"),
        needs.alias("requires_document"),
        pick(F.array(*map(F.lit, r.tags)).cast("array<string>") for r in all_rules).alias("tags"),
        S.is_correction(F.col(name)).alias("is_correction"),
        S.strip_prefixes(F.col(name)).alias("normalized_report_name"),
    )
