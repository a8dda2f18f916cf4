"""Opportunity records from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip, text

#: Numeric leaves are read as text, so numbers, numeric texts and nulls all survive.
SCHEMA = (
    "id STRING, title STRING, mechanism STRING, permission_status STRING, "
    "facts STRUCT<independent_revenue_signals: STRING, observed_price_floor_usd: STRING, observed_price_ceiling_usd: STRING>, "
    "hypotheses STRUCT<demand_strength: STRING, automation_fit: STRING, repeatability: STRING, distribution_access: STRING, upside_convexity: STRING>, "
    "validation STRUCT<cash_usd: STRING, human_hours: STRING, feedback_days: STRING, experiment: STRING, pass_condition: STRING, kill_condition: STRING>, "
    "risks STRUCT<capital_at_risk: STRING, platform_policy: STRING, legal: STRING>, "
    "signals ARRAY<STRUCT<kind: STRING, independence_key: STRING, url: STRING, note: STRING>>"
)
FLAT = {
    "independent_revenue_signals": "facts", "demand_strength": "hypotheses", "automation_fit": "hypotheses", "repeatability": "hypotheses",
    "distribution_access": "hypotheses", "upside_convexity": "hypotheses", "cash_usd": "validation", "human_hours": "validation",
    "feedback_days": "validation", "experiment": "validation", "pass_condition": "validation", "kill_condition": "validation",
    "capital_at_risk": "risks", "platform_policy": "risks", "legal": "risks",
}


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Parsed records of a table of JSON lines; blank ones and those that start with
    # are skipped. ``problem`` tells what is wrong with a record (null: nothing)."""
    raw = lines.select(strip(F.col(line)).alias("raw")).where("raw <> '' AND NOT startswith(raw, '#')")
    parsed = raw.withColumn("r", F.from_json("raw", SCHEMA + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    cid, title = text(F.col("r.id")), text(F.col("r.title"))
    problem = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "not a JSON object").when((cid == "") | (title == ""), "id and title are required")
    return parsed.select(
        cid.alias("candidate_id"), title.alias("title"), F.coalesce("r.mechanism", F.lit("unknown")).alias("mechanism"), F.col("r.permission_status").alias("permission_status"),
        *(F.col(f"r.{group}.{name}").alias(name) for name, group in FLAT.items()),
        F.col("r.signals").alias("signals"), problem.alias("problem"), "raw",
    )


def read_opportunities(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file, with ``ord`` (file order) and ``source``. A faulty line
    fails the whole source, with its text, as soon as this is called."""
    rows = parse_lines(spark.read.text(path)).withColumn("ord", F.monotonically_increasing_id())
    bad = rows.where("problem IS NOT NULL").select("problem", "raw").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {bad[0]['problem']}: {bad[0]['raw'][:120]}")
    return rows.drop("problem", "raw").withColumn("source", F.lit("opportunities"))
