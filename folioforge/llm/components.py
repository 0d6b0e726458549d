"""Connected components of a link table, without collecting it: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.explode(F.array(*[F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("u", "v")]))
    return down.join(least, "u").select(moved.alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each edge leads from a node without any other to one from which none leads: no step changes these."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("n")), F.struct(F.col("b").alias("node"), F.lit(0).alias("n")))).alias("e"))
    # The end that no edge leads from counts 0, so that a node has one 1, or zeros only.
    odd = ends.groupBy("e.node").agg(F.sum("e.n").alias("out"), F.min("e.n").alias("least")).where("out > 1 or out = 1 and least = 0")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b); each step is a table in the shared folder, so that the next
    does not make it again for each of its uses."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        edges = written(_small_star(written(_large_star(edges), "star")), "star")
        if _stars(edges):
            break
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
