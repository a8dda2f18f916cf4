"""The filing scan: classify, enrich, cluster, score; no step depends on another row's result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, risk, select, taxonomy
from ..sources.documents import document_rows, financial_snapshot, purpose_phrases
from .candidates import FrameSource


@dataclass(frozen=True)
class Scan:
    candidates: DataFrame
    counters: DataFrame


def enrich(filings: DataFrame, structured: DataFrame | None = None, archives: DataFrame | None = None) -> DataFrame:
    """Classified filings with facts and warnings. ``structured`` holds fact columns
    by rcept_no (of ``facts.normalise`` after the match), and by structured_kind and
    corp_code where it has them, so that filings that share a receipt get their own;
    of several rows of a key the least counts. ``archives`` (rcept_no, content) are
    read only for filings that need a document or have no facts, one a receipt."""
    rows = filings.withColumn("warnings", F.array().cast("array<string>"))
    if structured is not None:
        keys = ["rcept_no", *(k for k in ("structured_kind", "corp_code") if k in structured.columns)]
        values = [c for c in structured.columns if c not in keys]
        fact = structured.groupBy(*keys).agg(F.min(F.struct(F.lit(True).alias("sw_found"), *values)).alias("sw_fact")).select(*keys, "sw_fact.*")
        rows = rows.join(fact, keys, "left")
        said = F.concat(F.lit("접수번호와 일치하는 "), F.col("structured_kind"), F.lit(" 구조화 행을 찾지 못함"))
        missing = F.col("structured_kind").isNotNull() & F.col("sw_found").isNull()
        rows = rows.withColumn("warnings", F.when(missing, F.array(said)).otherwise(F.col("warnings")))
    else:
        rows = rows.withColumn("sw_found", F.lit(None).cast("boolean"))
    if archives is not None:
        wants = F.col("requires_document") | F.col("sw_found").isNull()
        needed = archives.join(rows.where(wants).select("rcept_no"), "rcept_no", "left_semi")
        parsed = document_rows(needed.groupBy("rcept_no").agg(F.min("content").alias("content")), "rcept_no", "content")
        parsed = parsed.select(
            "rcept_no", F.size("rows").alias("document_row_count"), F.nullif(purpose_phrases(F.col("rows")), F.array().cast("array<string>")).alias("business_purpose_phrases"),
            financial_snapshot(F.col("rows")).alias("document_financial_snapshot"), "problem", F.lit(True).alias("sw_wants"),
        )
        rows = rows.withColumn("sw_wants", wants).join(parsed, ["rcept_no", "sw_wants"], "left").drop("sw_wants")
        rows = rows.withColumn("warnings", F.when(F.col("problem").isNotNull(), F.array_append("warnings", F.col("problem"))).otherwise(F.col("warnings"))).drop("problem")
    return rows.drop("sw_found")


def scan(listing: DataFrame, *, structured: DataFrame | None = None, archives: DataFrame | None = None, seen: DataFrame | None = None, stored: DataFrame | None = None, include_seen: bool = False, lookback_days: int = 30, strict_causal: bool = False) -> Scan:
    """Scored candidates and the run's counters. Seen filings still count as classified."""
    classified = taxonomy.classify(listing)
    listed = F.col("stock_code") != ""
    known = classified
    if seen is not None and not include_seen:
        known = classified.join(seen.select(F.col("rcept_no").alias("sw_seen")).distinct(), F.col("rcept_no") == F.col("sw_seen"), "left")
        known = known.withColumn("sw_skip", F.col("sw_seen").isNotNull()).drop("sw_seen")
    else:
        known = known.withColumn("sw_skip", F.lit(False))
    relevant = listed & (F.col("category") != "other")
    counters = known.agg(
        F.count("*").alias("total_disclosures"), F.count_if(relevant).alias("classified_disclosures"),
        F.count_if(relevant & F.col("sw_skip")).alias("skipped_seen"), F.count_if(~listed).alias("skipped_unlisted"),
    )
    rows = known.where(relevant & ~F.col("sw_skip")).drop("sw_skip")
    rows = risk.with_facts(enrich(rows, structured, archives))
    rows = cluster.related_events(rows, stored, lookback_days, strict_causal)
    return Scan(risk.score_filings(rows), counters)


def candidates(scored: DataFrame) -> DataFrame:
    """Scored filings as rows of the candidate pipeline, numbered in scan order; filings
    that share a receipt and its scores by title and tags, so that no tie is left open."""
    rows = scored.select(
        F.concat(F.lit("dart:"), F.col("rcept_no")).alias("candidate_id"),
        F.concat_ws(" — ", "corp_name", "report_nm").alias("title"),
        F.col("attention_score"), F.col("financing_risk_score"),
        F.array_distinct(F.concat(F.array("category", "band"), F.col("cluster_tags"))).alias("tags"),
        F.lit(None).cast("array<double>").alias("embedding"),
        "rcept_dt", "rcept_no",
    )
    order = [F.col(c).desc() for c in ("attention_score", "financing_risk_score", "rcept_dt", "rcept_no")]
    order += [F.col("title").asc(), F.col("tags").asc()]
    return select.global_rank(rows, *order, name="ord").drop("rcept_dt", "rcept_no")


def filing_source(name: str, load) -> FrameSource:
    """A candidate source that scans the listing ``load(spark, start, end)`` gives."""

    def make(spark: SparkSession, query) -> DataFrame:
        for key in ("start_date", "end_date"):
            if not str(query.context.get(key) or "").strip():
                raise ValueError(f"{key} is required")
        rows = load(spark, query.context["start_date"], query.context["end_date"])
        return candidates(scan(rows).candidates)

    return FrameSource(name, make)

