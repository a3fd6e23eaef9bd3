"""Kernel projections of whole tables through random Fourier features.

The Gaussian kernel is the expected product of random cosine features, so its
principal components are those of the features: sums of their products are all
that the fit needs, no sample is drawn, and rows are projected where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Random features at most: the sums of their products reach the driver.
MOST_FEATURES = 1024


@dataclass(frozen=True)
class KernelProjection:
    """``axes`` (features x components) of centred features; ``explained`` is each one's share of the variance."""

    directions: np.ndarray
    phases: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier_features(x, self.directions, self.phases)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.features(x) - self.centre) @ self.axes


def fourier_features(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def fit_kernel_projection(rows: DataFrame, x: str = "x", components: int = 2, gamma: float | None = None, features: int = 512, seed: int = 42) -> KernelProjection:
    """Leading components for the kernel exp(-gamma |a - b|^2) over all rows with a vector.

    ``gamma`` is one over the vectors' width where not given.  Tasks add up the
    features and their products; the sums, ``features`` squared numbers, reach
    the driver.  The kernel's error falls with the square root of ``features``.
    """
    if features > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features")
    kept = rows.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"))
    sample = kept.select(F.size("x")).first()
    if sample is None:
        raise ValueError("no rows to project")
    width = sample[0]
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=np.sqrt(2 * (1 / width if gamma is None else gamma)), size=(width, features))
    phases = rng.uniform(0, 2 * np.pi, features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, n = np.zeros(features), np.zeros((features, features)), 0
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                z = fourier_features(_vectors(whole.slice(start, 2000).column(0), width), directions, phases)
                total, products, n = total + z.sum(0), products + z.T @ z, n + len(z)
        if n:  # a row per feature keeps rows small
            lists = [np.concatenate([[n, total[i]], products[i]]).tolist() for i in range(features)]
            yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array(lists, pa.list_(pa.float64()))], names=["feature", "sums"])

    parts = kept.mapInArrow(add, "feature int, sums array<double>")
    cells = parts.select("feature", F.posexplode("sums").alias("at", "v")).groupBy("feature", "at").agg(F.sum("v").alias("v"))
    packed = cells.groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums"))
    sums = np.array([r["sums"] for r in sorted(packed.collect(), key=lambda r: r["feature"])])  # one row per feature
    n, centre = sums[0, 0], sums[:, 1] / sums[0, 0]
    covariance = sums[:, 2:] / n - np.outer(centre, centre)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    chosen = axes[:, order]
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(0), np.arange(components)] < 0, -1.0, 1.0)
    return KernelProjection(directions, phases, centre, chosen, values[order] / max(values.sum(), 1e-300))


def projected(rows: DataFrame, projection: KernelProjection, x: str = "x", out: str = "axes") -> DataFrame:
    """All rows and columns with ``out``, the components of each vector; null for a null vector."""
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at, width = rows.columns.index(x), len(projection.directions)
    shared = rows.sparkSession.sparkContext.broadcast(projection)  # width x features numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            found: list = [None] * batch.num_rows
            there = [i for i, ok in enumerate(column.is_valid().to_pylist()) if ok]
            if there:
                for i, values in zip(there, shared.value.project(_vectors(column.take(pa.array(there)), width)).tolist(), strict=True):
                    found[i] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)
