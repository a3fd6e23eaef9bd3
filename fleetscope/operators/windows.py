"""Count windows, forecast pairs and chronological splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.numbers import share_of
from fleetscope.plans.storage import discard, stored


def numbered(df: DataFrame, session: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """Adds the position of each row in its session, from 0."""
    place = F.row_number().over(Window.partitionBy(*session).orderBy(*order)) - 1
    return df.withColumn(name, place.cast("long"))


#: Rows that a task may order; larger tables are cut into range partitions of about so many.
PART_ROWS = 1_000_000


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of rows with equal groups, where null equals null; the group's columns are the left ones.

    ``right`` holds a row or a few per group.  It is written, so that its size
    is known and the left rows are not shuffled by group where it is small.
    """
    other = stored(right, "groups").withColumnsRenamed({c: f"__of_{c}" for c in by})
    equal = F.lit(True)
    for c in by:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return left.join(other, equal, how).drop(*[f"__of_{c}" for c in by])


def dealt(df: DataFrame, group: Sequence[str], rows: int, part_rows: int | None = None) -> DataFrame:
    """The rows dealt out by group, about ``part_rows`` a task at most, where the session's number of shuffle partitions gives more.

    For ``rows`` rows in many groups; a window by these groups does not shuffle them again.
    """
    parts = -(-rows // (part_rows or PART_ROWS))
    return df.repartition(parts, *group) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _ranged(df: DataFrame, keys: Sequence[Column], part_rows: int | None) -> DataFrame:
    """The stored rows in range partitions numbered by ``__part``; a table of one part's size stays whole."""
    kept = stored(df, "rows")
    parts = -(-kept.count() // (part_rows or PART_ROWS))
    if parts <= 1:
        return kept.withColumn("__part", F.lit(0))
    ranged = stored(kept.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranged")
    discard(kept)
    return ranged


def numbered_at_scale(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "seq", part_rows: int | None = None) -> DataFrame:
    """As ``numbered``, for groups too large for one task.

    Rows are range-partitioned by group and order; each part numbers its own
    rows and adds the number of rows that the group has in the parts before.
    The order must be total, or equal rows may swap places.  A null group is a
    group like any other.
    """
    ranged = _ranged(df, [F.col(c) for c in (*group, *order)], part_rows)
    inside = Window.partitionBy("__part", *group).orderBy(*order)
    counts = ranged.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = same_group(ranged.withColumn("__in", F.row_number().over(inside) - 1), offsets, ["__part", *group])
    return placed.withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__part", "__in", "__before")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: Sequence[str], part_rows: int | None = None) -> DataFrame:
    """Adds ``run_<value>``, the sum of each value over the rows of the group up to this one.

    For groups too large for one task: rows are range-partitioned by group and
    order, and each part adds the group's sums in the parts before.  A null
    group is a group like any other.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    ranged = _ranged(df, keys, part_rows)
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part", *by).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    offsets = parts.select("__part", *by, *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    sums = same_group(ranged.select("*", *[F.sum(v).over(inside).alias(f"run_{v}") for v in values]), offsets, ["__part", *by])
    added = [(F.col(f"run_{v}") + F.col(f"__{v}")).alias(f"run_{v}") for v in values]
    return sums.select(*df.columns, *added)


#: Following rows that a row may look at, one column each; wider windows copy rows instead.
MOST_AHEAD = 48


def count_windows(df: DataFrame, session: Sequence[str], seq: str, value: Column, width: int, stride: int) -> DataFrame:
    """Full windows of ``width`` rows that start every ``stride`` rows and never cross a session.

    Rows are sorted once and never copied: runs as long as the greatest common
    divisor of width and stride become one row each, and a window is the runs
    from its first one on.  ``x`` is ordered by row; a session's numbers are
    unique.  Where that would look at more than ``MOST_AHEAD`` rows or runs,
    each row is copied to its windows.
    """
    run = math.gcd(width, stride)
    if max(run, width // run) > MOST_AHEAD:
        return _copied_windows(df, session, seq, value, width, stride)
    # A null value counts as a row.
    rows = df.select(*session, F.col(seq).cast("long").alias("__seq"), F.array(value).alias("__x"))
    ahead = Window.partitionBy(*session).orderBy("__seq")
    for size, steps, every in ((1, run, run), (run, width // run, stride)):
        if steps == 1:
            continue
        looks = rows.select("*", *[F.lead("__x", i).over(ahead).alias(f"__x{i}") for i in range(1, steps)], F.lead("__seq", steps - 1).over(ahead).alias("__last"))
        full = looks.where((F.col("__seq") % every == 0) & (F.col("__last") == F.col("__seq") + size * (steps - 1)))
        rows = full.select(*session, "__seq", F.concat("__x", *[f"__x{i}" for i in range(1, steps)]).alias("__x"))
    starts = rows.where((F.col("__seq") >= 0) & (F.col("__seq") % stride == 0))
    return starts.select(*session, F.floor(F.col("__seq") / stride).alias("k"), F.col("__x").alias("x"))


def _copied_windows(df: DataFrame, session: Sequence[str], seq: str, value: Column, width: int, stride: int) -> DataFrame:
    """As ``count_windows``.

    Row ``r`` belongs to windows ``max(0, ceil((r - width + 1) / stride)) ..
    floor(r / stride)``; each row is copied to those only (about width / stride
    times), and one aggregation builds the windows.
    """
    row = F.col(seq)
    first, last = F.greatest(F.ceil((row - (width - 1)) / stride), F.lit(0)), F.floor(row / stride)
    spread = df.where(first <= last).select(*session, seq, value.alias("__x"), F.explode(F.sequence(first, last)).alias("k"))
    packed = spread.groupBy(*session, "k").agg(
        F.count(F.lit(1)).alias("__n"), F.sort_array(F.collect_list(F.struct(seq, "__x"))).alias("__rows")
    )
    full = packed.where(F.col("__n") == width)
    return full.select(*session, "k", F.transform("__rows", lambda r: r["__x"]).alias("x"))


def expected_windows(rows: Column, width: int, stride: int) -> Column:
    """Windows that a session of ``rows`` rows has."""
    return F.greatest(F.floor((rows - width) / stride) + 1, F.lit(0)).cast("long")


def forecast_pairs(windows: DataFrame, session: Sequence[str], k: str, horizon: int, usable: Column | None = None) -> DataFrame:
    """Adds ``paired``: the next ``horizon`` windows of the session exist, are consecutive and usable."""
    ahead = Window.partitionBy(*session).orderBy(k)
    frame = ahead.rowsBetween(1, horizon)
    good = (F.coalesce(usable, F.lit(False)) if usable is not None else F.lit(True)).cast("int")
    ready = windows.withColumn("__good", good)
    complete = (F.count(F.lit(1)).over(frame) == horizon) & (F.min("__good").over(frame) == 1)
    consecutive = F.max(k).over(frame) == F.col(k) + horizon
    return ready.withColumn("paired", F.coalesce(complete & consecutive, F.lit(False))).drop("__good")


def position_pairs(position: Column, n_positions: Column, horizon: int) -> Column:
    """Whether a window at a position has ``horizon`` successors in its file."""
    return position < n_positions - horizon


def future_values(windows: DataFrame, session: Sequence[str], k: str, x: str, stride: int, horizon: int) -> DataFrame:
    """Adds ``future``: the last ``stride`` samples of each of the next windows, i.e. the contiguous time ahead."""
    ahead = Window.partitionBy(*session).orderBy(k)
    tails = [F.slice(F.lead(x, h).over(ahead), -stride, stride) for h in range(1, horizon + 1)]
    return windows.withColumn("future", F.flatten(F.array(*tails)))


def chronological_split(df: DataFrame, client: Sequence[str], order: Sequence[str], fit: float = 0.70, calib: float = 0.15) -> DataFrame:
    """Adds ``split``: by order, the first ``fit`` share, the next ``calib`` share, the rest for test; a null client is one too."""
    placed = numbered_at_scale(df, client, order, "__place")
    placed = same_group(placed, placed.groupBy(*client).agg(F.count(F.lit(1)).alias("__n")), client)
    n_fit, n_calib = share_of(F.col("__n"), fit), share_of(F.col("__n"), calib)
    name = F.when(F.col("__place") < n_fit, "fit").when(F.col("__place") < n_fit + n_calib, "calib").otherwise("test")
    return placed.withColumn("split", name).select(*df.columns, "split")


def hashed_split(df: DataFrame, strata: Sequence[str], key: str, train: float = 0.70, seed: int = 42) -> DataFrame:
    """Adds ``split`` train or test: a repeatable pseudo-random share of each stratum; a null stratum is one too."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    placed = numbered_at_scale(df.withColumn("__mixed", mixed), strata, ["__mixed", key], "__place")
    placed = same_group(placed, placed.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n")), strata)
    name = F.when(F.col("__place") < share_of(F.col("__n"), train), "train").otherwise("test")
    return placed.withColumn("split", name).select(*df.columns, "split")


def round_robin(df: DataFrame, group: Sequence[str], order: Sequence[str], clients: int) -> DataFrame:
    """Adds ``client``: files of a group dealt out in order."""
    placed = numbered_at_scale(df, group, order, "__place")
    return placed.withColumn("client", F.pmod("__place", F.lit(clients)).cast("long")).drop("__place")
