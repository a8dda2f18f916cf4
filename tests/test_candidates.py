"""Gates, axes, selectors and the candidate pipeline."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievewright.__main__ import opportunity_pipeline
from sievewright.operators import axes, gates, reports, select
from sievewright.plans import queries_opportunities
from sievewright.plans.candidates import CandidatePipeline, FrameSource, Selector
from sievewright.sources.opportunities import read_opportunities

RECORDS = [
    {"id": "a", "title": "A", "permission_status": "allowed", "facts": {"independent_revenue_signals": "4"}, "hypotheses": {"demand_strength": 0.9, "automation_fit": 2},
     "validation": {"cash_usd": 100, "human_hours": 8, "feedback_days": 7}, "risks": {"legal": 0.25}, "signals": [{"note": "n", "url": "u"}]},
    {"id": "b", "title": "B", "permission_status": "PROHIBITED", "facts": {"independent_revenue_signals": 9}},
    {"id": "c", "title": "C", "facts": None},
    {"id": "d", "title": "D", "facts": {"independent_revenue_signals": 2.9}, "validation": {"cash_usd": 500, "human_hours": 24}},
]


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("# head\n\n" + "\n".join(map(json.dumps, RECORDS)), encoding="utf-8")
    return str(path)


def test_pipeline_gates_scores_and_selects(spark, lines):
    result = opportunity_pipeline(lines).run(spark, gates.Query(limit=3))
    rows = result.selected.orderBy("rank").collect()
    assert [r.candidate_id for r in rows] == ["a", "d"]
    a = rows[0]
    assert (a.evidence_quality, a.cash_ease, a.human_ease, a.feedback_speed, a.safety, a.automation_fit, a.feasibility_floor) == (1.0, 0.5, 0.5, 0.5, 0.75, 1.0, 0.75)
    assert [r.title for r in result.filtered.orderBy("drop_stage", "ord").collect()] == ["B", "C"]
    metrics = {(r.stage, r.component): (r.input_count, r.output_count, r.removed_count) for r in result.metrics().collect()}
    assert metrics["filter", "permission_gate"] == (4, 3, 1) and metrics["filter", "minimum_evidence_gate"] == (3, 2, 1) and metrics["selector", "pareto"] == (2, 2, 0)
    report = reports.opportunity_report(result)
    assert "## 1. A" in report and "- n — u" in report and "## Filtered out" in report and "| safety | 0.750 |" in report


def test_faulty_line_fails_the_source_only(spark, tmp_path, lines):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": null, "title": "x"}\n')
    with pytest.raises(ValueError, match="id and title are required"):
        read_opportunities(spark, str(bad))
    sources = [FrameSource("bad", lambda s, q: read_opportunities(s, str(bad))), FrameSource("good", lambda s, q: read_opportunities(s, lines)), FrameSource("again", lambda s, q: read_opportunities(s, lines))]
    result = CandidatePipeline(sources=sources, selector=Selector("all", lambda q, rows: select.top_k(rows, "cash_usd", 9))).run(spark, gates.Query())
    assert len(result.warnings) == 1 and "bad failed" in result.warnings[0]
    assert result.retrieved.count() == 4 and {r.source for r in result.retrieved.collect()} == {"good"}
    with pytest.raises(ValueError, match="source"):
        CandidatePipeline(sources=[], selector=None)


def test_gate_bounds():
    with pytest.raises(ValueError, match="negative"):
        gates.minimum_evidence_gate(-1)


def test_selectors(spark):
    rows = spark.createDataFrame([(0, 1.0, [1.0, 0.0]), (1, 1.0, [1.0, 0.0]), (2, 0.6, [0.0, 1.0]), (3, None, None)], "ord long, s double, v array<double>")
    assert [r.ord for r in select.top_k(rows, "s", 9).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert select.top_k(rows, "s", -1).count() == 0
    assert [r.ord for r in select.mmr(rows, "s", "v", 2, weight=0.4).orderBy("rank").collect()] == [0, 2]
    with pytest.raises(ValueError, match="weight"):
        select.mmr(rows, "s", "v", 2, weight=1.5)


def test_pareto_layers_and_ties(spark):
    points = [("a", 1.0, 3.0), ("b", 3.0, 1.0), ("c", 1.0, 1.0), ("d", 1.0, 3.0), ("e", 0.5, 0.5), ("f", None, None)]
    rows = spark.createDataFrame(points, "candidate_id string, x double, y double").repartition(3)
    got = {r.candidate_id: r.layer for r in select.pareto_layers(rows, ("x", "y")).collect()}
    assert got == {"a": 1, "b": 1, "d": 1, "c": 2, "e": 3, "f": 4}
    ties = rows.withColumns({k: F.lit(0.0) for k in select.TIE_BREAK})
    assert [r.candidate_id for r in select.pareto_select(ties, 2, ("x", "y")).orderBy("rank").collect()] == ["d", "b"]
    with pytest.raises(ValueError, match="axes"):
        select.pareto_layers(rows, ())


def test_registered_pareto_query_peels_every_layer(spark):
    sf = "/root/testdata/sf0.001"
    rest = {r[0]: tuple(x or 0.0 for x in r[1:]) for r in queries_opportunities._scored(spark, sf).select("candidate_id", *select.PARETO_AXES).collect()}
    want, layer = {}, 0
    while rest:
        layer += 1
        front = [i for i, p in rest.items() if not any(q != p and all(x >= y for x, y in zip(q, p, strict=True)) for q in rest.values())]
        want.update({i: layer for i in front})
        rest = {i: p for i, p in rest.items() if i not in want}
    assert layer > 3
    assert {r.candidate_id: r.layer for r in queries_opportunities.top4_pareto_layers(spark, sf).collect()} == want


def test_later_scorer_wins(spark):
    rows = spark.range(1).select(*(F.lit(1.0).alias(c) for c in ("a",)))
    assert axes.score(rows, {"s": F.lit(1)}, {"s": F.lit(2)}).first().s == 2.0


def test_wide_frontiers_and_global_ranks(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(12) / 4, rng.randrange(12) / 4, None if i % 9 == 0 else rng.randrange(12) / 4) for i in range(300)]
    rows = spark.createDataFrame(points, "id long, x double, y double, z double").repartition(5)
    flat = [(i, [v or 0.0 for v in p]) for i, *p in points]
    best = {i for i, p in flat if not any(all(a >= b for a, b in zip(o, p, strict=True)) and o != p for _, o in flat)}
    assert {r.id for r in select.frontier(rows, ("x", "y", "z")).collect()} == best
    assert {r.id for r in select.frontier(rows, ("x", "y", "z"), block=3).collect()} == best
    got = select.global_rank(rows, F.col("x").desc(), F.col("id").asc()).orderBy("rank").collect()
    assert [r.id for r in got] == [i for i, *_ in sorted(points, key=lambda p: (-p[1], p[0]))] and [r["rank"] for r in got] == list(range(1, 301))
    assert select.global_rank(rows.where("false"), F.col("x").desc()).count() == 0


def test_many_layers_take_no_job_each(spark):
    """A chain of 40 layers beside random points, in blocks that cut through layers."""
    rng = random.Random(7)
    odd = [float("nan"), float("inf"), float("-inf"), None, -0.0]
    points = [(i, i / 4, i / 4, i / 4) for i in range(40)] + [(40 + i, *(rng.choice(odd) if rng.random() < 0.05 else rng.randrange(30) / 3 for _ in range(3))) for i in range(260)]
    rows = spark.createDataFrame(points, "candidate_id long, x double, y double, z double").repartition(5)
    spark.sparkContext.setJobGroup("layers", "")
    got = {r.candidate_id: r.layer for r in select.pareto_layers(rows, ("x", "y", "z")).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("layers")) < 40
    rest = {i: tuple(0.0 if v is None or v != v else v for v in p) for i, *p in points}
    want, layer = {}, 0
    while rest:
        layer += 1
        front = [i for i, p in rest.items() if not any(q != p and all(x >= y for x, y in zip(q, p, strict=True)) for q in rest.values())]
        want.update({i: layer for i in front})
        rest = {i: p for i, p in rest.items() if i not in want}
    assert layer >= 40 and got == want
    clean = rows.na.fill(0.0)
    for block in (7, 64):
        assert {r.candidate_id: r.layer for r in select._all_layers(clean, ("x", "y", "z"), block).collect()} == want
    assert select.pareto_layers(rows.where("false"), ("x", "y", "z")).count() == 0
