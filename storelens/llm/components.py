"""Connected components of an edge table by alternating large and small stars.

Each round points a node's larger neighbours, then its smaller ones, at the
smallest neighbour, until every component is one star around its smallest node.
Rounds grow with the logarithm of a component's diameter. A hub's minimum is
taken by a partial aggregate and its rows meet it in a join that adaptive
execution can split, so no task holds a hub's edges together. Edges are
written to the checkpoint folder every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = _least_neighbour(both).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge here runs from its larger to its smaller node.
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `component` (its smallest node) for every node with an edge to another one.

    Edges with a null end and edges from a node to itself are ignored.
    """
    ends = edges.where(F.col(a) != F.col(b))
    star = checkpointed(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(star)
    while state[0]:
        star = checkpointed(_small_star(_large_star(star)))
        last, state = state, _state(star)
        if state == last:
            break
    roots = star.select("v").distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
