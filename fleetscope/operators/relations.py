"""Relations between nodes: attention over neighbours, typed edges, regressions, clustered models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attended(cells: DataFrame, neighbours: DataFrame, window: list[str], slope: float = 0.2) -> DataFrame:
    """Per window and node: the neighbours' mean value by attention, and the squared residual.

    ``cells`` is ``window.., node, d``; ``neighbours`` is ``node, neighbour,
    logit`` with the learned score and any prior bias already added.  The
    weights do not depend on the window, so they are made once per node.
    """
    logit = F.when(F.col("logit") > 0, F.col("logit")).otherwise(slope * F.col("logit"))
    inside = Window.partitionBy("node")
    raw = neighbours.withColumn("__l", logit).withColumn("__e", F.exp(F.col("__l") - F.max("__l").over(inside)))
    weights = raw.select("node", "neighbour", (F.col("__e") / F.sum("__e").over(inside)).alias("__w"))
    source = cells.select(*window, F.col("node").alias("neighbour"), F.col("d").alias("__d"))
    expected = source.join(weights, "neighbour").groupBy(*window, "node").agg(F.sum(F.col("__w") * F.col("__d")).alias("expected"))
    joined = cells.join(expected, [*window, "node"])
    return joined.withColumn("residual", (F.col("d") - F.col("expected")) * (F.col("d") - F.col("expected")))


def edge_maps(cells: DataFrame, edges: DataFrame, client: str, window: list[str], least: int = 5) -> DataFrame:
    """Per client and edge: slope, intercept, mean and std of the residual on calibration cells; sums only."""
    pairs = _edge_pairs(cells, edges, client, window)
    fit = pairs.groupBy(client, "src", "dst").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n")
    )
    residual = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    spread = pairs.join(fit, [client, "src", "dst"]).groupBy(client, "src", "dst").agg(
        F.avg(residual).alias("mean"), (F.stddev_pop(residual) + 1e-8).alias("std")
    )
    return fit.join(spread, [client, "src", "dst"]).where(F.col("n") >= least)


def _edge_pairs(cells: DataFrame, edges: DataFrame, client: str, window: list[str]) -> DataFrame:
    x = cells.select(client, *window, F.col("node").alias("src"), F.col("d").alias("x"))
    y = cells.select(client, *window, F.col("node").alias("dst"), F.col("d").alias("y"))
    return x.join(edges, "src").join(y, [client, *window, "dst"])


def edge_residuals(cells: DataFrame, edges: DataFrame, maps: DataFrame, client: str, window: list[str]) -> DataFrame:
    """Per window and node the largest positive standardized residual of its incoming edges, 0 without edges."""
    pairs = _edge_pairs(cells, edges, client, window).join(maps, [client, "src", "dst"])
    z = (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x") - F.col("mean")) / F.col("std")
    worst = pairs.groupBy(*window, F.col("dst").alias("node")).agg(F.max(F.greatest(z, F.lit(0.0))).alias("r_edge"))
    return cells.join(worst, [*window, "node"], "left").withColumn("r_edge", F.coalesce("r_edge", F.lit(0.0)))


def nearest_replica(losses: DataFrame, client: str = "client", replica: str = "replica", loss: str = "loss") -> DataFrame:
    """The replica with the lowest loss per client; ties to the lowest replica."""
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(replica).alias("replica")))
    return losses.groupBy(client).agg(best.alias("__b")).select(client, F.col("__b.replica").alias(replica), F.col("__b.loss").alias(loss))


def forecast_residual(pairs: DataFrame, window: list[str], actual: str, expected: str) -> DataFrame:
    """Summed squared error over the forecast horizon, per window."""
    gaps = F.zip_with(actual, expected, lambda a, b: (a - b) * (a - b))
    return pairs.select(*window, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("k_resid"))


def regression_residuals(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Ordinary least squares per group: slope, intercept, r2."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
