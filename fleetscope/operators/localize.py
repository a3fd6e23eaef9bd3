"""Ranking the sensors behind an alarm and judging the ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.vectors import no_hit_chance


def top_nodes(z: DataFrame, window: Sequence[str], node: str, value: str, k: int, reliable: Column | None = None) -> DataFrame:
    """The ``k`` reliable nodes with the largest values per window; ties by lowest node."""
    rows = z.where(reliable) if reliable is not None else z
    order = Window.partitionBy(*window).orderBy(F.desc(value), node)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_node(z: DataFrame, window: Sequence[str], node: str, value: str, reliable: Column | None = None) -> DataFrame:
    """The first of ``top_nodes``, by one aggregation."""
    rows = z.where(reliable) if reliable is not None else z
    best = F.min(F.struct((-F.col(value)).alias("minus"), F.col(node).alias("node")))
    found = rows.groupBy(*window).agg(best.alias("__best"))
    return found.select(*window, F.col("__best.node").alias("node"), (-F.col("__best.minus")).alias("value"))


def blended(scalars: DataFrame, profiles: DataFrame, window: Sequence[str], signal: str, node: str, temperature: float = 1.0) -> DataFrame:
    """Per window and node the signals' profiles weighted by softmax of the window's scalar per signal.

    ``scalars`` has ``score``, ``profiles`` has ``z`` and ``reliable``; a node
    must be reliable in all signals.
    """
    inside = Window.partitionBy(*window)
    raw = scalars.withColumn("__w", F.exp((F.col("score") - F.max("score").over(inside)) / temperature))
    weights = raw.withColumn("__w", F.col("__w") / F.sum("__w").over(inside)).select(*window, signal, "__w")
    joined = profiles.join(weights, [*window, signal])
    mixed = joined.groupBy(*window, node).agg(
        F.sum(F.col("__w") * F.col("z")).alias("z"), F.bool_and("reliable").alias("reliable")
    )
    return mixed


def hits(top: DataFrame, domains: DataFrame, window: Sequence[str], fault: str, node: str) -> DataFrame:
    """Per window ``hit``: any of its top nodes lies in the fault's domain (an array of nodes)."""
    named = top.groupBy(*window, fault).agg(F.collect_set(node).alias("__nodes"))
    joined = named.join(domains, fault)
    return joined.select(*window, fault, F.arrays_overlap("__nodes", "domain").alias("hit"))


def hit_kind(node: Column, direct: Column, indirect: Column) -> Column:
    return F.when(F.array_contains(direct, node), "direct").when(F.array_contains(indirect, node), "indirect").otherwise("other")


def chance_of_hit(n: Column, d: Column, k: int) -> Column:
    """Chance that ``k`` random nodes of ``n`` touch a domain of ``d``."""
    return 1 - no_hit_chance(n, d, k)
