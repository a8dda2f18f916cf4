"""Connected components of an undirected edge table, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, comp) of every vertex of ``edges`` (a, b): comp is the smallest vertex
    reachable. Each round contracts: a vertex moves to the least of its neighbours and
    itself (a partial aggregate, so hot vertices are no burden), by number in the first
    round, then by a hash that is new in each round; so a round leaves at most two thirds
    of the vertices on the average, of chains too. Only edges that still connect two
    vertices go on. Rounds cut lineage in the shared folder."""
    spark = edges.sparkSession
    left, at = written(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    moves, paths = [], []
    for i in range(max_rounds):
        ranked = lambda v: F.struct((F.xxhash64(v, F.lit(i)) if i else F.col(v)).alias("r"), F.col(v).alias("v"))  # noqa: B023, E731
        both = left.unionByName(left.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        move, move_at = written(least.select(F.col("a").alias("v"), F.least(ranked("a"), "m")["v"].alias("comp")), "moves")
        moves.append(move)
        paths += [at, move_at]
        moved = left.join(move.selectExpr("v AS a", "comp AS x"), "a").join(move.selectExpr("v AS b", "comp AS y"), "b")
        left, at = written(moved.where("x <> y").selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct(), "edges")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"edges still connect vertices after {max_rounds} rounds")
    labels = moves.pop()
    if moves:
        for move in reversed(moves):
            labels = move.join(labels.selectExpr("v AS comp", "comp AS up"), "comp", "left").selectExpr("v", "coalesce(up, comp) AS comp")
        labels, labels_at = written(labels, "labels")
        # Written, so that AQE can split the join at a large component.
        smallest, smallest_at = written(labels.groupBy("comp").agg(F.min("v").alias("m")), "smallest")
        labels, _ = written(labels.join(smallest, "comp").selectExpr("v", "m AS comp"), "components")
        paths += [labels_at, smallest_at, move_at]
    else:
        paths.remove(move_at)  # after one round the number decided, so labels are the smallest already
    discard(spark, at, *paths)
    return labels


def merged_components(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (v, comp) of a graph, after ``edges`` (a, b) were added to it: only edges
    between two of its components are gone through."""
    ends = edges.join(comps.selectExpr("v AS a", "comp AS x"), "a", "left").join(comps.selectExpr("v AS b", "comp AS y"), "b", "left")
    more = connected_components(ends.selectExpr("coalesce(x, a) AS a", "coalesce(y, b) AS b"))
    old = comps.join(more.selectExpr("v AS comp", "comp AS up"), "comp", "left").selectExpr("v", "coalesce(up, comp) AS comp")
    return written(old.unionByName(more.join(comps.select("v"), "v", "left_anti").select("v", "comp")), "merged")[0]
