"""Connected components of an edge table, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the component's smallest node.

    Alternates two steps until each component is a star: every node hands the smallest
    of itself and its neighbours to its larger neighbours, then to its smaller
    ones.  Both only group and join by node, so a hub is never gathered in one
    row, and the number of edges does not grow.  Self-loops and repeated edges
    are allowed; null ends are ignored.  The result is a written table.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("__u"), F.least("m", "u").alias("m")
        )
        chosen = (F.col("v") > F.col("u")) if large else (F.col("v") <= F.col("u"))
        moved = pairs.join(lowest, F.col("u") == F.col("__u"))
        kept = moved.where(chosen).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:  # the node itself follows its smallest neighbour
            kept = kept.unionByName(lowest.select(F.col("__u").alias("a"), F.col("m").alias("b")))
        return kept.where("a <> b").distinct()

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )

    def settled(links: DataFrame) -> bool:
        """Whether every larger end has one link and is no smaller end: each component is a star around its smallest node."""
        larger, smaller = F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))
        seen = links.select(F.inline(F.array(larger, smaller))).groupBy("node")
        ups = seen.agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        return not ups.agg(F.bool_or(F.expr("ups > 1 or (ups = 1 and least = 0)"))).first()[0]

    ends = edges.where("a is not null and b is not null")
    current = materialize(
        ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while not settled(current):
        after_large = star(both(current), True)
        pointed = after_large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        before, current = current, materialize(star(pointed, False), "stars")
        discard(before)
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    everyone = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = leaves.groupBy("node").agg(F.min("label").alias("label"))
    labels = materialize(everyone.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    discard(current)
    return labels
