"""Clients with skewed sizes or conditions, as contiguous slices of what they have."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.windows import numbered_at_scale, same_group


def dirichlet_budgets(clients: Sequence, total: int, alpha: float, least: int, seed: int = 42) -> dict:
    """Rows per client drawn from a symmetric Dirichlet law, at least ``least`` each."""
    shares = np.random.default_rng(seed).dirichlet([alpha] * len(clients))
    return {c: max(least, int(total * s)) for c, s in zip(clients, shares, strict=True)}


def take_slices(df: DataFrame, budgets: DataFrame, client: str, order: Sequence[str], start: Column | None = None) -> DataFrame:
    """Of each client ``budget`` consecutive rows, from ``start`` (0 where not given) in the given order."""
    first = start if start is not None else F.lit(0)
    joined = same_group(numbered_at_scale(df, [client], order, "__p"), budgets, [client])
    return joined.where((F.col("__p") >= first) & (F.col("__p") < first + F.col("budget"))).select(*df.columns)


def beta_shares(clients: Sequence, alpha: float, seed: int = 42) -> dict:
    """A Beta(alpha, alpha) share per client, drawn in the order of the clients."""
    rng = np.random.default_rng(seed)
    return {c: float(rng.beta(alpha, alpha)) for c in clients}


def scenario_mix(df: DataFrame, client: str, scenario: str, inside: str, order: Sequence[str], alpha: float, least: int = 20, seed: int = 42) -> DataFrame:
    """``client, scenario, available, taken``: a Beta(alpha, alpha) share of each client from one scenario.

    Each scenario is capped by what the client has, and a slice below ``least``
    becomes none.  Clients are few; their shares are drawn on the driver.
    """
    sizes = df.groupBy(client, scenario).agg(F.count(F.lit(1)).alias("available"))
    names = sorted(r[0] for r in df.select(client).distinct().collect())
    kind = df.schema[client].dataType.simpleString()
    shares = df.sparkSession.createDataFrame(list(beta_shares(names, alpha, seed).items()), f"{client} {kind}, __share double")
    sizes = sizes.join(shares, client)
    whole = F.sum("available").over(Window.partitionBy(client))
    part = F.when(F.col(scenario) == inside, F.col("__share")).otherwise(1 - F.col("__share"))
    wanted = F.least(F.floor(whole / 2 * part), F.col("available"))
    return sizes.withColumn("taken", F.when(wanted >= least, wanted).otherwise(0).cast("long")).drop("__share")
