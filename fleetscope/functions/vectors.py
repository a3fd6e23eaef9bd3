"""Vector arithmetic on array columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; vectors shorter than 1e-12 count as that long."""
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), floor) * F.greatest(F.sqrt(dot(b, b)), floor))


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def split_nodes(vector: Column, nodes: int, width: int) -> Column:
    """A flat vector as ``nodes`` rows of ``width`` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda i: F.slice(vector, i * width + 1, width))


def top_mean(values: Column, k: int) -> Column:
    """Mean of the ``k`` largest values, of all where there are fewer."""
    return mean(F.slice(F.sort_array(values, asc=False), 1, k))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Weights proportional to exp(value / temperature), shifted by the maximum first."""
    raw = F.transform(values, lambda x: F.exp((x - F.array_max(values)) / temperature))
    return F.transform(raw, lambda w: w / total(raw))


def smooth_max(values: Column, temperature: float = 1.0) -> Column:
    """Mean weighted by softmax: the maximum as temperature falls, the mean as it rises."""
    return dot(values, softmax(values, temperature))


def quadratic(vector: Column, matrix: Column) -> Column:
    """``v' M v`` for a matrix given as an array of rows."""
    return dot(vector, F.transform(matrix, lambda row: dot(row, vector)))


def contributions(vector: Column, matrix: Column) -> Column:
    """Per entry ``v_i (M v)_i``; the entries sum to the quadratic form."""
    return F.zip_with(vector, F.transform(matrix, lambda row: dot(row, vector)), lambda x, y: x * y)


def poincare_map(vector: Column, eps: float = 1e-5) -> Column:
    """Exponential map at the origin of the unit ball, clipped just inside it."""
    length = F.greatest(F.sqrt(dot(vector, vector)), F.lit(eps))
    scale = F.tanh(length) / length
    inside = F.transform(vector, lambda x: x * scale)
    size = F.sqrt(dot(inside, inside))
    return F.transform(inside, lambda x: x * F.least(F.lit(1.0), (1 - eps) / F.greatest(size, F.lit(eps))))


def poincare_distance(a: Column, b: Column) -> Column:
    """Hyperbolic distance of two points inside the unit ball."""
    gap = sq_distance(a, b)
    room = (1 - dot(a, a)) * (1 - dot(b, b))
    return F.acosh(F.greatest(1 + 2 * gap / F.greatest(room, F.lit(1e-12)), F.lit(1.0)))


def no_hit_chance(n: Column, d: Column, k: int) -> Column:
    """Chance that ``k`` of ``n`` nodes drawn at random miss a domain of ``d`` nodes."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda p, i: p * F.greatest(n - d - i, F.lit(0)).cast("double") / F.greatest(n - i, F.lit(1)).cast("double"),
    )


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    if any(not math.isfinite(x) for row in rows for x in row):
        raise ValueError("matrix entries must be finite")
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
