"""Report tables across methods and parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Method:
    """A detection method: ``run`` gives its metrics per client, none where it is not implemented.

    A ``supervised`` method learns from fault labels and is not comparable with the rest.
    """

    name: str
    run: Callable[[SparkSession, str], DataFrame] | None = None
    supervised: bool = False


def implemented(methods: Iterable[Method]) -> list[Method]:
    return [m for m in methods if m.run is not None]


def compared(methods: Iterable[Method], spark: SparkSession, sf_dir: str, metric: str = "auroc") -> DataFrame:
    """``comparison`` of the implemented methods; clients without the metric do not count."""
    return comparison({m.name: (m.run(spark, sf_dir).where(F.col(metric).isNotNull()), not m.supervised) for m in implemented(methods)}, metric)


def registry(methods: Sequence[Method], results: DataFrame) -> DataFrame:
    """``method, supervised, implemented`` of all methods with the ``clients`` that have results, 0 without any."""
    rows = [(m.name, m.supervised, m.run is not None) for m in methods]
    listed = results.sparkSession.createDataFrame(rows, "method string, supervised boolean, implemented boolean")
    return listed.join(results.select("method", "clients"), "method", "left").withColumn("clients", F.coalesce("clients", F.lit(0)))


def comparison(results: Mapping[str, tuple[DataFrame, bool]], metric: str = "auroc") -> DataFrame:
    """``method, <metric>, clients, comparable`` from one table of per-client metrics per method."""
    named = [
        df.select(F.lit(name).alias("method"), F.col(metric), F.lit(fair).alias("comparable"))
        for name, (df, fair) in results.items()
    ]
    rows = reduce(DataFrame.unionByName, named)
    return rows.groupBy("method", "comparable").agg(F.avg(metric).alias(metric), F.count(F.lit(1)).alias("clients"))


def sweep(run: Callable[[float], DataFrame], values: Iterable[float], name: str, sink: str | None = None) -> DataFrame:
    """The union of ``run(value)`` over a grid; with ``sink`` each step is appended there as soon as it is done."""
    parts = []
    for value in values:
        part = run(value).withColumn(name, F.lit(float(value)))
        if sink:
            part.write.mode("append").parquet(sink)
        parts.append(part)
    if sink:
        return parts[0].sparkSession.read.schema(parts[0].schema).parquet(sink)
    return reduce(DataFrame.unionByName, parts)
