"""Hard gates and the filter stage.

A gate is a boolean Column per query; gates in sequence become one column that
names the first failing gate, so the stage is one projection and its metrics are
one aggregate instead of a pass for each filter.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Query:
    """What a run asks for: free context values and a row limit."""

    context: Mapping[str, Any] = field(default_factory=dict)
    limit: int = 10


@dataclass(frozen=True)
class Gate:
    name: str
    keep: Callable[[Query], Column]


def _context_number(query: Query, key: str, default: float) -> float:
    try:
        return float(query.context.get(key, default))
    except (TypeError, ValueError):
        return float(default)


def permission_gate(column: str = "permission_status") -> Gate:
    """Only an explicit prohibition is dropped; missing is unknown and passes."""
    return Gate("permission_gate", lambda q: F.lower(F.coalesce(F.col(column).cast("string"), F.lit("unknown"))) != "prohibited")


def minimum_evidence_gate(minimum: int = 2, column: str = "independent_revenue_signals") -> Gate:
    if minimum < 0:
        raise ValueError("minimum must not be negative")

    def keep(q: Query) -> Column:
        least = int(_context_number(q, "minimum_revenue_signals", minimum))
        return S.number(F.col(column)).cast("bigint") >= least

    return Gate("minimum_evidence_gate", keep)


def validation_budget_gate(max_cash_usd: float = 500.0, max_human_hours: float = 24.0) -> Gate:
    def keep(q: Query) -> Column:
        cash = _context_number(q, "max_cash_usd", max_cash_usd)
        hours = _context_number(q, "max_human_hours", max_human_hours)
        return (S.number(F.col("cash_usd")) <= cash) & (S.number(F.col("human_hours")) <= hours)

    return Gate("validation_budget_gate", keep)


def drop_stage(gates: Sequence[Gate], query: Query) -> Column:
    """The index of the first failing gate; null for rows that pass all."""
    out = F.lit(None).cast("int")
    for i, gate in reversed(list(enumerate(gates))):
        out = F.when(~F.coalesce(gate.keep(query), F.lit(False)), i).otherwise(out)
    return out


def apply_gates(rows: DataFrame, gates: Sequence[Gate], query: Query) -> tuple[DataFrame, DataFrame]:
    """(kept, removed); removed rows carry drop_stage, the order in which a
    sequence of filters would have removed them."""
    marked = rows.withColumn("drop_stage", drop_stage(gates, query))
    return marked.where("drop_stage IS NULL").drop("drop_stage"), marked.where("drop_stage IS NOT NULL")


def gate_metrics(rows: DataFrame, gates: Sequence[Gate], query: Query) -> DataFrame:
    """Input, output and removed counts of every gate, from one aggregate."""
    counts = rows.groupBy(drop_stage(gates, query).alias("s")).agg(F.count("*").alias("n"))
    stages = rows.sparkSession.createDataFrame([(i, g.name) for i, g in enumerate(gates)], "stage int, component string")
    # A handful of rows: one for each gate and one for the passing rows.
    reached = stages.join(F.broadcast(counts), F.coalesce("s", F.lit(len(gates))) >= F.col("stage"), "left")
    sums = reached.groupBy("stage", "component").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_count"),
        F.coalesce(F.sum(F.when(F.col("s") == F.col("stage"), F.col("n"))), F.lit(0)).alias("removed_count"),
    )
    return sums.select("stage", "component", "input_count", (F.col("input_count") - F.col("removed_count")).alias("output_count"), "removed_count")


def listed_only(filings: DataFrame) -> DataFrame:
    return filings.where(S.text(F.col("stock_code")) != "")


def with_receipt(filings: DataFrame) -> DataFrame:
    return filings.where(S.text(F.col("rcept_no")) != "")


def classified_only(filings: DataFrame) -> DataFrame:
    return filings.where("category <> 'other'")


def at_least_band(scored: DataFrame, minimum: str = "watch") -> DataFrame:
    return scored.where(S.band_rank(F.col("band")) >= S.BAND_RANK[minimum])
