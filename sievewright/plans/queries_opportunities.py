"""Queries over opportunities: sources, gates, axes and selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import axes, cluster, gates, select
from ..sources.opportunities import FLAT, parse_lines
from .candidates import CandidatePipeline, FrameSource, Hydrator, Scorer, Selector
from .views import table, view, with_views

GATES = (gates.permission_gate(), gates.minimum_evidence_gate(), gates.validation_budget_gate())
QUERY = gates.Query(limit=10)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "opportunities_v").withColumn("ord", F.col("candidate_id"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = gates.apply_gates(_rows(spark, sf), GATES, QUERY)
    return axes.score(kept, axes.opportunity_axes())


def src2_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Opportunities written as JSON lines with comments and blanks between, parsed again."""
    rows = view(spark, sf, "opportunities_v")
    groups = {g: F.struct(*(F.col(n).alias(n) for n, of in FLAT.items() if of == g and n in rows.columns)) for g in dict.fromkeys(FLAT.values())}
    record = F.struct(F.col("candidate_id").alias("id"), "title", "mechanism", "permission_status", *(v.alias(g) for g, v in groups.items()))
    lines = rows.select(F.explode(F.array(F.to_json(record), F.lit("# note"), F.lit("   "))).alias("value"))
    parsed = parse_lines(lines).where("problem IS NULL")
    numbers = [n for n in FLAT if n in rows.columns]
    return parsed.select(F.col("candidate_id").cast("long").alias("candidate_id"), "title", "mechanism", "permission_status", *(F.round(S.number(F.col(n)), 6).alias(n) for n in numbers))


def flt1_drop_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("candidate_id", gates.drop_stage(GATES, QUERY).alias("drop_stage"))


def _one_gate(gate: gates.Gate):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        kept, _ = gates.apply_gates(_rows(spark, sf), [gate], QUERY)
        return kept.select("candidate_id")

    return run


def prj1_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    """A hydrator that adds a column and drops rows, with its metrics."""
    pipeline = CandidatePipeline(
        sources=[FrameSource("parts", lambda s, q: _rows(s, sf))],
        hydrators=[Hydrator("brands", lambda q, rows: rows.join(table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), "p_brand"), "candidate_id").where("p_brand <> 'Brand#11'"))],
        selector=Selector("top", lambda q, rows: select.top_k(rows, "demand_strength", 3)),
    )
    return pipeline.run(spark, QUERY).metrics().where("stage = 'hydrator'")


def prj2_scorer_override(spark: SparkSession, sf: str) -> DataFrame:
    late = {"safety": F.lit(0.5), "own": F.col("human_hours") * 2}
    return axes.score(_rows(spark, sf), axes.opportunity_axes(), late).select("candidate_id", "safety", "own")


def prj4_axes(spark: SparkSession, sf: str) -> DataFrame:
    return axes.score(_rows(spark, sf), axes.opportunity_axes()).select("candidate_id", *(F.round(a, 9).alias(a) for a in axes.AXES))


def top1_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report over a score that is missing for some rows."""
    rows = _rows(spark, sf).withColumn("s", F.when(F.col("candidate_id") % 13 != 0, F.col("candidate_id") % 97))
    return select.top_k(rows, "s", 25).select("candidate_id", "rank")


def top2_mmr(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return select.mmr(rows, "label", "embedding", 5, weight=0.4, order="vec_id").select("vec_id", "rank")


def top3_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against one stated vector."""
    rows = table(spark, sf, "embeddings")
    first = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return rows.join(F.broadcast(first)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


def top4_pareto_layers(spark: SparkSession, sf: str) -> DataFrame:
    return select.pareto_layers(_scored(spark, sf)).select("candidate_id", "layer")


def top5_pareto_select(spark: SparkSession, sf: str) -> DataFrame:
    """Gates, axes, Pareto layers and tie-break: the shortlist."""
    return select.pareto_select(_scored(spark, sf), QUERY.limit).select("candidate_id", "layer", "rank", "title")


def pipe1_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The whole candidate pipeline with a failing second source."""

    def broken(s, q):
        raise ValueError("not there")

    result = _pipeline(sf, FrameSource("broken", broken)).run(spark, QUERY)
    return result.selected.select("candidate_id", "rank", F.lit(len(result.warnings)).alias("n_warnings"))


def _pipeline(sf: str, *more) -> CandidatePipeline:
    return CandidatePipeline(
        sources=[FrameSource("parts", lambda s, q: _rows(s, sf)), FrameSource("again", lambda s, q: _rows(s, sf).where("candidate_id % 2 = 0")), *more],
        gates=GATES,
        scorers=[Scorer("opportunity_axes", lambda q: axes.opportunity_axes())],
        selector=Selector("top_k", lambda q, rows: select.top_k(rows, "feasibility_floor", q.limit)),
    )


def agg12_stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _pipeline(sf).run(spark, QUERY).metrics()


def agg1_first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cluster.first_by_key(docs, "text", "doc_id").select("doc_id")


def agg2_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cluster.latest_by_key(docs, "text", "doc_id").select("doc_id")


def agg8_minmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf)
    span = rows.agg(F.min("feasibility_floor").alias("lo"), F.max("feasibility_floor").alias("hi"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("feasibility_floor") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return rows.join(F.broadcast(span)).select("candidate_id", F.round(norm, 9).alias("relevance"))


QUERIES = {
    f.__name__: f
    for f in (
        src2_jsonl, flt1_drop_stage, prj1_hydrate, prj2_scorer_override, prj4_axes, top1_topk, top2_mmr, top3_cosine, top4_pareto_layers,
        top5_pareto_select, pipe1_candidates, agg12_stage_metrics, agg1_first_wins_dedup, agg2_last_wins, agg8_minmax,
    )
} | {"flt3_permission_gate": _one_gate(GATES[0]), "flt4_evidence_gate": _one_gate(GATES[1]), "flt5_budget_gate": _one_gate(GATES[2])}

# ---- the same in DuckDB SQL ----
_N = {n: f"coalesce({n}, 0.0)" for n in FLAT}
_UNIT = {n: f"least(greatest(coalesce({n}, 0.0), 0.0), 1.0)" for n in FLAT}
_AXES = {
    "demand_strength": _UNIT["demand_strength"],
    "evidence_quality": f"least(greatest({_N['independent_revenue_signals']}, 0.0) / 4, 1.0)",
    "automation_fit": _UNIT["automation_fit"],
    "distribution_access": _UNIT["distribution_access"],
    "cash_ease": f"1 / (1 + greatest({_N['cash_usd']}, 0.0) / 100)",
    "human_ease": f"1 / (1 + greatest({_N['human_hours']}, 0.0) / 8)",
    "feedback_speed": f"1 / (1 + greatest({_N['feedback_days']}, 0.0) / 7)",
    "safety": f"1 - greatest({_UNIT['capital_at_risk']}, {_UNIT['platform_policy']}, {_UNIT['legal']})",
    "repeatability": _UNIT["repeatability"],
    "upside_convexity": _UNIT["upside_convexity"],
}
_AXES["feasibility_floor"] = f"least({_AXES['demand_strength']}, {_AXES['evidence_quality']}, {_AXES['automation_fit']}, {_AXES['safety']})"
_G3 = "lower(coalesce(permission_status, 'unknown')) <> 'prohibited'"
_G4 = "trunc(coalesce(independent_revenue_signals, 0)) >= 2"
_G5 = "coalesce(cash_usd, 0) <= 500 AND coalesce(human_hours, 0) <= 24"
_V = with_views("opportunities_v")
_SCORED = _V + f", scored AS (SELECT candidate_id, title, {', '.join(f'{v} AS {k}' for k, v in _AXES.items())} FROM opportunities_v WHERE {_G3} AND {_G4} AND {_G5})"
_DOM = " AND ".join(f"o.{a} >= s.{a}" for a in select.PARETO_AXES) + " AND (" + " OR ".join(f"o.{a} > s.{a}" for a in select.PARETO_AXES) + ")"


def _peel(n: int) -> str:
    out = ""
    for i in range(1, n + 1):
        rest = "scored" if i == 1 else f"(SELECT * FROM scored WHERE {' AND '.join(f'candidate_id NOT IN (SELECT candidate_id FROM l{j})' for j in range(1, i))})"
        out += f", l{i} AS MATERIALIZED (SELECT s.* FROM {rest} s WHERE NOT EXISTS (SELECT 1 FROM {rest} o WHERE {_DOM}))"
    return out


_BY = ", ".join(f"{c} DESC" for c in (*select.TIE_BREAK, "candidate_id"))
_COS = "coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"
_COS_AB = _COS.format(a="CAST(e.embedding AS DOUBLE[])", b="CAST(q.embedding AS DOUBLE[])")


def _mmr_sql(k: int, w: float) -> str:
    rel = "CASE WHEN hi > lo THEN (coalesce(label, 0) - lo) / (hi - lo) ELSE 1.0 END"
    parts = [f"base AS (SELECT vec_id, embedding, {rel} AS rel FROM embeddings, (SELECT min(coalesce(label, 0))::DOUBLE AS lo, max(coalesce(label, 0))::DOUBLE AS hi FROM embeddings))"]
    for i in range(1, k + 1):
        sims = [f"(SELECT {_COS_AB} FROM p{j} q)" for j in range(1, i)]
        sim = "0.0" if not sims else sims[0] if len(sims) == 1 else f"greatest({', '.join(sims)})"
        skip = "".join(f" AND vec_id <> (SELECT vec_id FROM p{j})" for j in range(1, i))
        parts.append(f"p{i} AS MATERIALIZED (SELECT vec_id, embedding FROM base e WHERE true{skip} ORDER BY {w} * rel - {1 - w} * {sim} DESC, vec_id LIMIT 1)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT vec_id, {i} AS rank FROM p{i}" for i in range(1, k + 1))


_NUMBERS = ", ".join(f"round(coalesce({n}, 0.0), 6) AS {n}" for n in FLAT if n not in ("experiment", "pass_condition", "kill_condition"))
ORACLES = {
    "src2_jsonl": f"{_V} SELECT candidate_id, title, coalesce(mechanism, 'unknown') AS mechanism, permission_status, {_NUMBERS} FROM opportunities_v",
    "flt1_drop_stage": f"{_V} SELECT candidate_id, CASE WHEN NOT ({_G3}) THEN 0 WHEN NOT ({_G4}) THEN 1 WHEN NOT ({_G5}) THEN 2 END AS drop_stage FROM opportunities_v",
    "flt3_permission_gate": f"{_V} SELECT candidate_id FROM opportunities_v WHERE {_G3}",
    "flt4_evidence_gate": f"{_V} SELECT candidate_id FROM opportunities_v WHERE {_G4}",
    "flt5_budget_gate": f"{_V} SELECT candidate_id FROM opportunities_v WHERE {_G5}",
    "prj1_hydrate": f"{_V} SELECT 'hydrator' AS stage, 'brands' AS component, count(*) AS input_count, count(*) FILTER (WHERE p_brand <> 'Brand#11') AS output_count, count(*) - count(*) FILTER (WHERE p_brand <> 'Brand#11') AS removed_count FROM opportunities_v JOIN part ON p_partkey = candidate_id",
    "prj2_scorer_override": f"{_V} SELECT candidate_id, CAST(0.5 AS DOUBLE) AS safety, human_hours * 2 AS own FROM opportunities_v",
    "prj4_axes": f"{_V} SELECT candidate_id, {', '.join(f'round({v}, 9) AS {k}' for k, v in _AXES.items())} FROM opportunities_v",
    "top1_topk": f"{_V} SELECT candidate_id, CAST(row_number() OVER (ORDER BY CASE WHEN candidate_id % 13 <> 0 THEN candidate_id % 97 END DESC NULLS LAST, candidate_id) AS INTEGER) AS rank FROM opportunities_v QUALIFY rank <= 25",
    "top2_mmr": _mmr_sql(5, 0.4),
    "top3_cosine": f"SELECT e.vec_id, round({_COS_AB}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    "top4_pareto_layers": _SCORED + f", rest AS (SELECT 1 AS k, * FROM scored UNION ALL SELECT s.k + 1, s.* EXCLUDE (k) FROM rest s WHERE EXISTS (SELECT 1 FROM rest o WHERE {_DOM})) SELECT candidate_id, CAST(max(k) AS INTEGER) AS layer FROM rest GROUP BY candidate_id",
    "top5_pareto_select": _SCORED + _peel(1) + f" SELECT candidate_id, 1 AS layer, CAST(row_number() OVER (ORDER BY {_BY}) AS INTEGER) AS rank, title FROM l1 QUALIFY rank <= 10",
    "pipe1_candidates": _SCORED + " SELECT candidate_id, CAST(row_number() OVER (ORDER BY feasibility_floor DESC, candidate_id) AS INTEGER) AS rank, 1 AS n_warnings FROM scored QUALIFY rank <= 10",
    "agg12_stage_metrics": f"""{_V}, m AS (SELECT *, CASE WHEN NOT ({_G3}) THEN 0 WHEN NOT ({_G4}) THEN 1 WHEN NOT ({_G5}) THEN 2 ELSE 3 END AS d FROM opportunities_v),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE d >= 1) AS a, count(*) FILTER (WHERE d >= 2) AS b, count(*) FILTER (WHERE d >= 3) AS c, count(*) FILTER (WHERE candidate_id % 2 = 0) AS e FROM m)
SELECT 'source' AS stage, 'parts' AS component, 0::BIGINT AS input_count, n AS output_count, 0::BIGINT AS removed_count FROM n
UNION ALL SELECT 'source', 'again', 0, 0, e FROM n
UNION ALL SELECT 'filter', 'permission_gate', n, a, n - a FROM n UNION ALL SELECT 'filter', 'minimum_evidence_gate', a, b, a - b FROM n
UNION ALL SELECT 'filter', 'validation_budget_gate', b, c, b - c FROM n UNION ALL SELECT 'scorer', 'opportunity_axes', c, c, 0 FROM n
UNION ALL SELECT 'selector', 'top_k', c, least(c, 10), greatest(c - 10, 0) FROM n""",
    "agg1_first_wins_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "agg2_last_wins": "SELECT max(doc_id) AS doc_id FROM documents GROUP BY text",
    "agg8_minmax": _SCORED + ", s AS (SELECT min(feasibility_floor) AS lo, max(feasibility_floor) AS hi FROM scored) SELECT candidate_id, round(CASE WHEN hi > lo THEN (feasibility_floor - lo) / (hi - lo) ELSE 1.0 END, 9) AS relevance FROM scored, s",
}
