"""Calibrated deviation scores, fusion across signals and two-level averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.numbers import robust_z
from fleetscope.operators.windows import running_sums, same_group


def ranked_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Per group: n and ``q``, the interpolated quantiles.

    Equal values are counted first, so a value that fills most of a group is
    one row; running counts over the distinct values then place each rank.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_sums(counted, by, ["__v"], ["__c"])
    sizes = placed.groupBy(*by).agg(F.sum("__c").alias("n"))
    within = lambda rank: ((rank >= F.col("run___c") - F.col("__c")) & (rank < F.col("run___c"))).cast("double")
    sums = []
    for share in shares:
        at = F.lit(share) * (F.col("n") - 1)
        rest = at - F.floor(at)
        sums.append(F.sum(F.col("__v") * (within(F.floor(at)) * (1 - rest) + within(F.floor(at) + 1) * rest)))
    return same_group(placed, sizes, by).groupBy(*by, "n").agg(F.array(*sums).alias("q")).select(*by, "n", "q")


def robust_stats(df: DataFrame, by: Sequence[str], value: str, method: str = "ranked") -> DataFrame:
    """Per group: n, ``med`` and ``iqr`` with linear interpolation.

    ``ranked`` adds up the counts of distinct values over range partitions, so
    the size of a group does not matter.
    ``percentile`` counts distinct values of a group in one buffer, which suits
    many moderate groups.
    """
    shares = (0.25, 0.5, 0.75)
    if method == "percentile":
        clean = df.where(F.col(value).isNotNull())
        quartiles = F.percentile(F.col(value), F.array(*[F.lit(s) for s in shares]))
        found = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), quartiles.alias("q"))
    elif method == "ranked":
        found = ranked_quantiles(df, by, value, shares)
    else:
        raise ValueError(f"unknown method {method}")
    return found.select(*by, "n", F.col("q")[1].alias("med"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def z_scores(df: DataFrame, stats: DataFrame, by: Sequence[str], value: str, floor: float = 1e-8) -> DataFrame:
    """Adds ``z`` from the group's statistics."""
    joined = same_group(df, stats.select(*by, F.col("med").alias("__m"), F.col("iqr").alias("__i")), by)
    return joined.withColumn("z", robust_z(F.col(value), F.col("__m"), F.col("__i"), floor)).drop("__m", "__i")


def informative_floor(stats: DataFrame, client: str, share: float) -> DataFrame:
    """Raises each ``iqr`` to a share of the median of the client's informative (over 1e-6) ones."""
    informative = F.percentile(F.when(F.col("iqr") > 1e-6, F.col("iqr")), F.lit(0.5)).over(Window.partitionBy(client))
    return stats.withColumn("iqr", F.greatest("iqr", F.lit(share) * F.coalesce(informative, F.lit(0.0)), F.lit(1e-8)))


def max_over_nodes(z: DataFrame, window: Sequence[str]) -> DataFrame:
    return z.groupBy(*window).agg(F.max("z").alias("score"))


def top_k_mean(z: DataFrame, window: Sequence[str], k: int) -> DataFrame:
    """Mean of the ``k`` largest node values of a window."""
    ordered = F.slice(F.sort_array(F.collect_list("z"), asc=False), 1, k)
    packed = z.groupBy(*window).agg(ordered.alias("__top"))
    total = F.aggregate("__top", F.lit(0.0), lambda s, x: s + x)
    return packed.select(*window, (total / F.size("__top")).alias("score"))


def two_stage(df: DataFrame, calib: Column, client: str, window: Sequence[str], node: str, value: str, k: int) -> DataFrame:
    """Node z-scores, mean of the top ``k``, and a second robust z of that statistic; calibration rows fit both."""
    marked = df.withColumn("__calib", calib)
    first = robust_stats(marked.where("__calib"), [client, node], value)
    z = z_scores(marked, first, [client, node], value)
    means = top_k_mean(z, [*window, client, "__calib"], k)
    second = robust_stats(means.where("__calib"), [client], "score")
    return z_scores(means, second, [client], "score").drop("__calib")


def prototype_stats(df: DataFrame, client: str, m: str, node: str, value: str, least: int = 5, method: str = "percentile") -> DataFrame:
    """Robust statistics per (client, prototype, node) and, with null prototype, per (client, node).

    ``valid`` needs ``least`` rows (the client-wide rows are always valid).
    ``percentile`` is one pass with grouping sets, whose buffers hold a group's
    distinct values; ``ranked`` suits groups of any size.  Rows without a value
    do not count.
    """
    rows = df.where(F.col(value).isNotNull())
    if method == "ranked":
        kind = df.schema[m].dataType
        shares = (0.25, 0.5, 0.75)
        own = ranked_quantiles(rows, [client, m, node], value, shares).withColumn("__whole", F.lit(0))
        whole = ranked_quantiles(rows, [client, node], value, shares).withColumns({m: F.lit(None).cast(kind), "__whole": F.lit(1)})
        sets = own.unionByName(whole).withColumnRenamed("q", "__q")
    elif method == "percentile":
        quartiles = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        keys = [F.col(client), F.col(m), F.col(node)], [F.col(client), F.col(node)]
        sets = rows.groupingSets([*keys], client, m, node).agg(F.count(F.lit(1)).alias("n"), quartiles.alias("__q"), F.grouping(m).alias("__whole"))
    else:
        raise ValueError(f"unknown method {method}")
    return sets.select(
        client, m, node, "n", F.col("__q")[1].alias("med"), (F.col("__q")[2] - F.col("__q")[0]).alias("iqr"),
        ((F.col("n") >= least) | (F.col("__whole") == 1)).alias("valid"), (F.col("__whole") == 1).alias("overall"),
    )


def prototype_z(df: DataFrame, stats: DataFrame, client: str, m: str, node: str, value: str) -> DataFrame:
    """Adds ``z`` by the row's own prototype, by the client's statistics where that one is not valid."""
    own = stats.where("valid and not overall").select(client, m, node, F.col("med").alias("__m"), F.col("iqr").alias("__i"))
    whole = stats.where("overall").select(client, node, F.col("med").alias("__gm"), F.col("iqr").alias("__gi"))
    joined = df.join(own, [client, m, node], "left").join(whole, [client, node], "left")
    z = robust_z(F.col(value), F.coalesce("__m", "__gm"), F.coalesce("__i", "__gi"))
    return joined.withColumn("z", z).drop("__m", "__i", "__gm", "__gi")


def confidence_weights(losses: DataFrame, client: str, signal: str, loss: str, temperature: float = 1.0) -> DataFrame:
    """Adds ``weight``: per client the softmax over signals of minus the loss's z-score across clients."""
    across = Window.partitionBy(signal)
    spread = F.stddev_pop(loss).over(across) + F.lit(1e-8)
    z = losses.withColumn("__z", -(F.col(loss) - F.avg(loss).over(across)) / spread / temperature)
    inside = Window.partitionBy(client)
    raw = z.withColumn("__w", F.exp(F.col("__z") - F.max("__z").over(inside)))
    return raw.withColumn("weight", F.col("__w") / F.sum("__w").over(inside)).drop("__z", "__w")


def weighted_combination(scores: DataFrame, weights: DataFrame, window: Sequence[str], client: str, signal: str, score: str) -> DataFrame:
    joined = scores.join(weights.select(client, signal, "weight"), [client, signal])
    return joined.groupBy(*window, client).agg(F.sum(F.col("weight") * F.col(score)).alias("score"))


def smooth_max_over(scores: DataFrame, window: Sequence[str], score: str, temperature: float = 1.0) -> DataFrame:
    """Softmax-weighted mean of a window's signals."""
    top = F.max(score).over(Window.partitionBy(*window))
    weighed = scores.withColumn("__w", F.exp((F.col(score) - top) / temperature))
    return weighed.groupBy(*window).agg((F.sum(F.col("__w") * F.col(score)) / F.sum("__w")).alias("score"))


def mean_of_means(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Mean over the inner groups' means, so every inner group counts the same."""
    inside = df.groupBy(*outer, *inner).agg(F.avg(value).alias("__mean"))
    return inside.groupBy(*outer).agg(F.avg("__mean").alias("mean"), F.count(F.lit(1)).alias("groups"))


def most_common(df: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of a group with counts; ties by value."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
