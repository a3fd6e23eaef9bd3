"""Prototype memory: assignment, usage, covariance calibration and node graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.vectors import contributions, cosine, quadratic, sq_distance, total


def codebook(prototypes: DataFrame, client: str = "client", m: str = "m", nodes: str = "z") -> DataFrame:
    """One row per client with its prototypes as an array ordered by ``m``."""
    return prototypes.groupBy(client).agg(F.sort_array(F.collect_list(F.struct(m, nodes))).alias("codes"))


def assign(windows: DataFrame, prototypes: DataFrame, weights: Column | None = None, client: str = "client") -> DataFrame:
    """Adds ``m``, ``d_proto`` and ``d_node``: nearest prototype of the client by weighted squared distance.

    ``z`` is an array of node vectors.  The codebook travels as one row per
    client, so windows are neither multiplied nor shuffled by prototype; equal
    distances go to the lowest ``m``.
    """
    joined = windows.join(codebook(prototypes, client), client)

    def apart(code: Column) -> Column:
        per_node = F.zip_with(F.col("z"), code["z"], sq_distance)
        weighted = F.zip_with(per_node, weights, lambda d, w: d * w) if weights is not None else per_node
        return F.struct(total(weighted).alias("d"), code["m"].alias("m"), per_node.alias("n"))

    best = F.array_min(F.transform("codes", apart))
    found = joined.withColumn("__best", best).drop("codes")
    return found.select(
        *[c for c in found.columns if c != "__best"],
        F.col("__best.m").alias("m"),
        F.col("__best.d").alias("d_proto"),
        F.col("__best.n").alias("d_node"),
    )


def usage(assigned: DataFrame, prototypes: DataFrame, client: str = "client") -> DataFrame:
    """Windows per prototype, 0 for unused ones."""
    counts = assigned.groupBy(client, "m").agg(F.count(F.lit(1)).alias("n"))
    return prototypes.select(client, "m").join(counts, [client, "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def utilization(used: DataFrame, client: str = "client") -> DataFrame:
    """Share of prototypes in use."""
    return used.groupBy(client).agg(F.avg((F.col("n") > 0).cast("double")).alias("utilization"))


def commitment(assigned: DataFrame, prototypes: DataFrame, client: str = "client") -> DataFrame:
    """Mean squared difference between embeddings and their prototypes, per client."""
    codes = prototypes.select(client, "m", F.col("z").alias("__code"))
    cells = assigned.join(codes, [client, "m"]).select(
        client, F.explode(F.zip_with(F.flatten("z"), F.flatten("__code"), lambda x, y: (x - y) * (x - y))).alias("e")
    )
    return cells.groupBy(client).agg(F.avg("e").alias("loss"))


def moments(deviations: DataFrame, by: list[str], column: str = "d_node") -> DataFrame:
    """Per group and node pair: n, sums and sums of products; partial sums combine before the shuffle.

    These moments are all that a covariance needs, so no group of raw windows
    is ever gathered.
    """
    i = deviations.select(*by, F.col(column).alias("__d"), F.posexplode(column).alias("i", "a"))
    cells = i.select(*by, "i", "a", F.posexplode("__d").alias("j", "b")).where("j >= i")
    return cells.groupBy(*by, "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("b")).alias("sab")
    )


def covariance_stats(deviations: DataFrame, by: list[str], ridge: float = 0.01, min_samples: int = 5, column: str = "d_node") -> DataFrame:
    """Per group: n, ``mu``, ``precision`` (inverse of sample covariance + ridge), ``valid``.

    The inverse is taken per group from its (nodes x nodes) moments in a pandas
    function; a group has as many rows as node pairs, whatever its window count.
    """
    sums = moments(deviations, by, column)
    keys = sums.select(*by).schema

    def invert(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["j"].max()) + 1
        n = int(part["n"].iloc[0])
        mu, cov = np.zeros(size), np.zeros((size, size))
        for r in part.itertuples():
            if r.i == r.j:
                mu[r.i] = r.sa / n
            cov[r.i, r.j] = cov[r.j, r.i] = (r.sab - r.sa * r.sb / n) / max(n - 1, 1)
        precision = np.linalg.inv(cov + ridge * np.eye(size))
        row = {k: part[k].iloc[0] for k in by}
        row |= {"n": n, "mu": mu.tolist(), "precision": precision.tolist(), "valid": n >= max(min_samples, 2)}
        return pd.DataFrame([row])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.fields)
    schema = f"{fields}, n long, mu array<double>, precision array<array<double>>, valid boolean"
    return sums.groupBy(*by).applyInPandas(invert, schema)


def mahalanobis(assigned: DataFrame, per_prototype: DataFrame, overall: DataFrame, client: str = "client") -> DataFrame:
    """Adds ``d_mahal`` and ``h_node`` (entries that sum to it), with the client's statistics where a prototype's are not valid."""
    own = per_prototype.where("valid").select(client, "m", F.col("mu").alias("__mu"), F.col("precision").alias("__p"))
    whole = overall.select(client, F.col("mu").alias("__gmu"), F.col("precision").alias("__gp"))
    joined = assigned.join(own, [client, "m"], "left").join(whole, client, "left")
    mu, precision = F.coalesce("__mu", "__gmu"), F.coalesce("__p", "__gp")
    centred = joined.withColumn("__c", F.zip_with("d_node", mu, lambda x, y: x - y)).withColumn("__q", precision)
    return (
        centred.withColumn("d_mahal", quadratic(F.col("__c"), F.col("__q")))
        .withColumn("h_node", contributions(F.col("__c"), F.col("__q")))
        .drop("__mu", "__p", "__gmu", "__gp", "__c", "__q")
    )


def nearest_nodes(nodes: DataFrame, k: int, key: str = "node", vector: str = "vec") -> DataFrame:
    """``node, rank, neighbour, sim``: the ``k`` most similar other nodes by cosine; ties by lowest node.

    Meant for node tables, whose size is the number of sensors.
    """
    other = nodes.select(F.col(key).alias("neighbour"), F.col(vector).alias("__v"))
    pairs = nodes.join(other, F.col(key) != F.col("neighbour"))
    scored = pairs.select(F.col(key).alias("node"), "neighbour", F.round(cosine(F.col(vector), F.col("__v")), 12).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
