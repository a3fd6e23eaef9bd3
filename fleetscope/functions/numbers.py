"""Scalar cleaning functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Numeric text as a double, true and false (any case, trimmed) as 1 and 0, anything else null."""
    plain = F.lower(F.trim(text.cast("string")))
    return F.when(plain == "true", 1.0).when(plain == "false", 0.0).otherwise(plain.try_cast("double"))


def share_of(n: Column, share: float) -> Column:
    """``floor(n * share)`` in double arithmetic, as chronological splits count."""
    return F.floor(n.cast("double") * F.lit(float(share))).cast("long")


def robust_z(value: Column, median: Column, iqr: Column, floor: float = 1e-8) -> Column:
    return (value - median) / F.greatest(iqr, F.lit(floor))
