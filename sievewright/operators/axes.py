"""Score axes of an opportunity: independent columns, never netted into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import number, unit

AXES = (
    "demand_strength", "evidence_quality", "automation_fit", "distribution_access", "cash_ease", "human_ease",
    "feedback_speed", "safety", "repeatability", "upside_convexity", "feasibility_floor",
)


def _ease(column: str, scale: float) -> Column:
    return 1 / (1 + F.greatest(number(F.col(column)), F.lit(0.0)) / scale)


def opportunity_axes() -> dict[str, Column]:
    """Axis name to expression over the flat opportunity columns."""
    hypothesis = lambda c: unit(number(F.col(c)))
    evidence = F.least(F.greatest(number(F.col("independent_revenue_signals")), F.lit(0.0)) / 4, F.lit(1.0))
    safety = 1 - F.greatest(*(hypothesis(c) for c in ("capital_at_risk", "platform_policy", "legal")))
    demand, fit = hypothesis("demand_strength"), hypothesis("automation_fit")
    return {
        "demand_strength": demand,
        "evidence_quality": evidence,
        "automation_fit": fit,
        "distribution_access": hypothesis("distribution_access"),
        "cash_ease": _ease("cash_usd", 100),
        "human_ease": _ease("human_hours", 8),
        "feedback_speed": _ease("feedback_days", 7),
        "safety": safety,
        "repeatability": hypothesis("repeatability"),
        "upside_convexity": hypothesis("upside_convexity"),
        "feasibility_floor": F.least(demand, evidence, fit, safety),
    }


def score(rows: DataFrame, *scorers: dict[str, Column]) -> DataFrame:
    """Add the scorers' columns; where two give one name, the later wins. Scorers
    read the input rows, so a score may have the name of an input column."""
    merged: dict[str, Column] = {}
    for s in scorers:
        merged |= s
    return rows.withColumns({k: v.cast("double") for k, v in merged.items()})
