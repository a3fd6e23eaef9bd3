"""Cleaning, resampling, standardization and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_gaps(df: DataFrame, columns: Sequence[str], session: Sequence[str], order: Sequence[str], default: float = 0.0) -> DataFrame:
    """Carry values forward, then backward, inside a session; a column without values becomes ``default``."""
    ahead = Window.partitionBy(*session).orderBy(*order)
    past = ahead.rowsBetween(Window.unboundedPreceding, 0)
    future = ahead.rowsBetween(0, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(future), F.lit(default)) for c in columns
    }
    return df.withColumns(filled)


def select_nodes(columns: Sequence[str], groups: Mapping[str, Sequence[str]], active: Sequence[str], exclude_prefix: str = "") -> list[str]:
    """Columns of the active groups in source order; unknown groups or columns are an error."""
    unknown = [g for g in active if g not in groups]
    wanted = {c for g in active if g in groups for c in groups[g]}
    missing = sorted(wanted - set(columns))
    if unknown or missing:
        raise ValueError(f"unknown groups {unknown}, missing columns {missing}")
    return [c for c in columns if c in wanted and not (exclude_prefix and c.startswith(exclude_prefix))]


def stack_nodes(df: DataFrame, columns: Sequence[str], name: str = "x") -> DataFrame:
    """The columns as one array, the node axis."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns])).drop(*columns)


def grid_bins(df: DataFrame, session: str, time_us: str, width_us: int, anchor: Column | None = None) -> DataFrame:
    """Adds ``bin``: whole widths since the session's first (anchor) sample, which may lie inside a natural bin."""
    start = F.min(F.when(anchor, F.col(time_us)) if anchor is not None else F.col(time_us)).over(Window.partitionBy(session))
    return df.withColumn("bin", F.floor((F.col(time_us) - start) / F.lit(width_us)).cast("long")).where("bin >= 0")


def resample(
    df: DataFrame, session: str, time_us: str, node: str, value: str, nodes: Sequence[str], width_us: int, fill: bool = True
) -> DataFrame:
    """Regular grid per session: the mean of every node in each bin, on all bins from first to last.

    One aggregation by (session, bin) computes all nodes; the full grid is a
    generated sequence per session, so no calendar table is needed.
    """
    binned = grid_bins(df, session, time_us, width_us)
    means = binned.groupBy(session, "bin").agg(
        *[F.avg(F.when(F.col(node) == n, F.col(value))).alias(n) for n in nodes]
    )
    span = means.groupBy(session).agg(F.max("bin").alias("last"))
    grid = span.select(session, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    full = grid.join(means, [session, "bin"], "left")
    return fill_gaps(full, nodes, [session], ["bin"]) if fill else full


def array_split_block(position: Column, length: Column, blocks: int) -> Column:
    """Block of a position when ``length`` rows are cut in ``blocks`` nearly equal runs, longer ones first."""
    small = F.floor(length / blocks)
    longer = length % blocks
    head = longer * (small + 1)
    return F.when(position < head, F.floor(position / (small + 1))).otherwise(
        longer + F.floor((position - head) / F.greatest(small, F.lit(1)))
    ).cast("long")


def decimate_blocks(df: DataFrame, session: Sequence[str], position: str, value: str, blocks: int, mode: str = "mean") -> DataFrame:
    """Mean or root mean square of each block of a session."""
    if mode not in ("mean", "rms"):
        raise ValueError(f"unknown mode {mode}")
    length = F.count(F.lit(1)).over(Window.partitionBy(*session))
    keyed = df.withColumn("block", array_split_block(F.col(position), length, blocks))
    level = F.avg(value) if mode == "mean" else F.sqrt(F.avg(F.col(value) * F.col(value)))
    return keyed.groupBy(*session, "block").agg(level.alias("value"), F.count(F.lit(1)).alias("n"))


def decimate_factor(df: DataFrame, session: Sequence[str], position: str, value: str, factor: int) -> DataFrame:
    """Box average of ``factor`` consecutive samples."""
    block = F.floor(F.col(position) / factor).cast("long")
    return df.groupBy(*session, block.alias("block")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


def truncate_to_shortest(df: DataFrame, group: Sequence[str], session: Sequence[str], position: str) -> DataFrame:
    """Keep of every session as many rows as the group's shortest has."""
    lengths = df.groupBy(*group, *session).agg(F.count(F.lit(1)).alias("length"))
    shortest = lengths.groupBy(*group).agg(F.min("length").alias("shortest"))
    return df.join(shortest, list(group)).where(F.col(position) < F.col("shortest")).drop("shortest")


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), fit: Column | None = None) -> DataFrame:
    """``(x - mean) / std`` with population statistics of the fit rows; a std below 1e-8 counts as 1.

    Statistics are one row per group and are joined back; the join is broadcast
    by the planner while they are small.
    """
    rows = df.where(fit) if fit is not None else df
    stats = rows.groupBy(*by).agg(
        *[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    joined = df.join(stats, list(by), "left") if by else df.crossJoin(F.broadcast(stats))  # one row
    scaled = {
        c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") < 1e-8, 1.0).otherwise(F.col(f"__s_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def long_enough(df: DataFrame, session: Sequence[str], window: int) -> DataFrame:
    """Rows of sessions with at least one full window."""
    keep = df.groupBy(*session).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= window).select(*session)
    return df.join(keep, list(session), "left_semi")


def reliable_nodes(stats: DataFrame, client: str = "client", iqr: str = "iqr", share: float = 0.05) -> DataFrame:
    """Adds ``reliable``: the node's spread is at least ``share`` of the client's median spread."""
    middle = F.percentile(F.col(iqr), F.lit(0.5)).over(Window.partitionBy(client))
    return stats.withColumn("reliable", F.col(iqr) >= F.lit(share) * middle)
