"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join of the edges with one row a node,
so a node with very many links is split like any skewed join key. Each round's edges are written to the
shared folder, which cuts the lineage; rounds grow with the logarithm of the longest path.

Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b) hooked to the smallest neighbour: of larger neighbours, or of the node and smaller ones."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of edges (a, b) and the smallest node it can reach."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        now = written(_star(_star(now, True), False), "star")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = (state["n"], state["h"])
