"""Connected components by alternating stars, on edges that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest vertex around each vertex.

    The minimum is a partial aggregate and goes back by a join whose skewed side
    Spark may split, so a vertex with very many neighbours holds up no task.
    """
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges  # u > v
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = around.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any order, any repeats -> (u, v): each vertex but the smallest with its component's smallest.

    Each round brings vertices nearer to the smallest; it ends when a round changes
    nothing, after about the square of the logarithm of the number of vertices.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges)
    state = _state(edges)
    while state[0]:
        edges = written(_star(_star(edges, large=True), large=False))
        now = _state(edges)
        if now == state:
            return edges
        state = now
    return edges
