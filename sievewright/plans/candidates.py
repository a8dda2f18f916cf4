"""The generic candidate pipeline: sources, hydrators, gates, scorers, a selector."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.axes import score
from ..operators.cluster import first_by_key
from ..operators.gates import Gate, Query, apply_gates, gate_metrics


class Source(Protocol):
    """Rows with candidate_id and ord (their order)."""

    name: str

    def fetch(self, spark: SparkSession, query: Query) -> DataFrame: ...


@dataclass(frozen=True)
class FrameSource:
    """A source from a function of (spark, query)."""

    name: str
    make: Callable[[SparkSession, Query], DataFrame]

    def fetch(self, spark: SparkSession, query: Query) -> DataFrame:
        return self.make(spark, query)


@dataclass(frozen=True)
class Hydrator:
    name: str
    hydrate: Callable[[Query, DataFrame], DataFrame]


@dataclass(frozen=True)
class Scorer:
    name: str
    score: Callable[[Query], dict[str, Column]]


@dataclass(frozen=True)
class Selector:
    name: str
    select: Callable[[Query, DataFrame], DataFrame]


@dataclass
class Result:
    """Lazy tables of every stage; metrics are computed when asked for."""

    fetched: DataFrame
    retrieved: DataFrame
    hydrated: DataFrame
    filtered: DataFrame
    selected: DataFrame
    warnings: list[str]
    steps: list[tuple[str, str, DataFrame, DataFrame]] = field(default_factory=list)
    gates: Sequence[Gate] = ()
    query: Query = field(default_factory=Query)

    def metrics(self) -> DataFrame:
        """stage, component, input_count, output_count, removed_count, one row a component."""
        unique = self.retrieved.groupBy("source_ord").agg(F.count("*").alias("n"))
        sources = self.fetched.groupBy("source_ord", "source").agg(F.count("*").alias("all_n")).join(unique, "source_ord", "left")
        rows = sources.select(
            F.lit("source").alias("stage"), F.col("source").alias("component"), F.lit(0).cast("long").alias("input_count"),
            F.coalesce("n", F.lit(0)).alias("output_count"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("removed_count"),
        )
        for stage, name, before, after in self.steps:
            counts = before.agg(F.count("*").alias("i")).join(F.broadcast(after.agg(F.count("*").alias("o"))))
            rows = rows.unionByName(counts.select(
                F.lit(stage).alias("stage"), F.lit(name).alias("component"), F.col("i").alias("input_count"),
                F.col("o").alias("output_count"), F.greatest(F.col("i") - F.col("o"), F.lit(0)).alias("removed_count"),
            ))
        if self.gates:
            gated = gate_metrics(self.hydrated, self.gates, self.query)
            rows = rows.unionByName(gated.select(F.lit("filter").alias("stage"), "component", "input_count", "output_count", "removed_count"))
        return rows


class CandidatePipeline:
    def __init__(self, *, sources: Sequence[Source], selector: Selector, hydrators: Sequence[Hydrator] = (), gates: Sequence[Gate] = (), scorers: Sequence[Scorer] = ()):
        if not sources:
            raise ValueError("at least one source is required")
        self.sources, self.selector, self.hydrators, self.gates, self.scorers = sources, selector, hydrators, gates, scorers

    def run(self, spark: SparkSession, query: Query) -> Result:
        """A source that fails is left out with a warning; any other error is raised.
        Of candidates with one id the first by source and order stays."""
        warnings, fetched = [], None
        for i, source in enumerate(self.sources):
            try:
                rows = source.fetch(spark, query)
                rows.schema  # analysis errors belong to the source
            except Exception as e:  # fail-open by design
                warnings.append(f"source {source.name} failed: {e}")
                continue
            rows = rows.withColumn("source", F.lit(source.name)).withColumn("source_ord", F.lit(i))
            fetched = rows if fetched is None else fetched.unionByName(rows, allowMissingColumns=True)
        if fetched is None:
            fetched = spark.createDataFrame([], "candidate_id string, title string, ord long, source string, source_ord int")
        retrieved = first_by_key(fetched, "candidate_id", "source_ord", "ord")
        rows, steps = retrieved, []
        for h in self.hydrators:
            after = h.hydrate(query, rows)
            steps.append(("hydrator", h.name, rows, after))
            rows = after
        hydrated = rows
        kept, filtered = apply_gates(rows, self.gates, query)
        scored = score(kept, *(s.score(query) for s in self.scorers)) if self.scorers else kept
        steps += [("scorer", s.name, kept, kept) for s in self.scorers]
        selected = self.selector.select(query, scored)
        steps.append(("selector", self.selector.name, scored, selected))
        return Result(fetched, retrieved, hydrated, filtered, selected, warnings, steps, self.gates, query)
