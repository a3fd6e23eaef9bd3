"""Readers of session files and writers of datasets and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_sessions(spark: SparkSession, path: str, columns: Mapping[str, str], pattern: str = "*.csv") -> DataFrame:
    """Session CSV files below ``path`` as text columns renamed by ``columns`` (file name -> node name).

    Files whose name starts with ``._`` are skipped.  A file without one of the
    columns is an error.  ``file`` is the file's path; other columns are not read.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    raw = reader.csv(path)
    missing = sorted(set(columns) - set(raw.columns))
    if missing:
        raise ValueError(f"columns not in the files: {missing}")
    plain = ~F.element_at(F.split("_metadata.file_path", "/"), -1).startswith("._")
    return raw.where(plain).select(
        F.col("_metadata.file_path").alias("file"), *[F.col(a).alias(b) for a, b in columns.items()]
    )


def path_part(file: Column, place: int) -> Column:
    """A component of the path, counted from the end with negative ``place``."""
    return F.element_at(F.split(file, "/"), place)


def coded(value: Column, table: Mapping[str, int | str], what: str) -> Column:
    """The value's code; an unknown value is an error that names it."""
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    known = F.try_element_at(codes, value)
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))))


def nanosecond_time(text: Column) -> Column:
    """Epoch nanoseconds as a timestamp; Spark keeps microseconds."""
    return F.timestamp_micros(F.floor(text.cast("long") / 1000).cast("long"))


def read_topics(spark: SparkSession, path: str, time_column: str, fields: Mapping[str, str]) -> DataFrame:
    """Long rows ``session, topic, ts, node, value`` from files named ``<session>-<topic>.csv``.

    ``fields`` maps a field of the files to its node name; files that lack a
    field give no rows for it.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    present = {f: n for f, n in fields.items() if f in raw.columns}
    cells = F.array(*[F.struct(F.lit(n).alias("node"), F.col(f"`{f}`").try_cast("double").alias("value")) for f, n in present.items()])
    return raw.select(
        F.regexp_extract(name, r"^(.*?)-", 1).alias("session"),
        F.regexp_extract(name, r"^.*?-(.*)\.csv$", 1).alias("topic"),
        nanosecond_time(F.col(f"`{time_column}`")).alias("ts"),
        F.explode(cells).alias("cell"),
    ).select("session", "topic", "ts", "cell.node", "cell.value").where("value is not null")


def fault_onsets(topics: DataFrame, surfaces: Mapping[str, str]) -> DataFrame:
    """``session, onset, surfaces``: the earliest failure message and the set of failed surfaces."""
    failed = topics.withColumn("surface", coded(F.col("topic"), surfaces, "failure topic"))
    return failed.groupBy("session").agg(F.min("ts").alias("onset"), F.sort_array(F.collect_set("surface")).alias("surfaces"))


def parse_name(file: Column, pattern: str, parts: Sequence[str]) -> list[Column]:
    """The groups of a file-name pattern as columns."""
    name = F.element_at(F.split(file, "/"), -1)
    return [F.regexp_extract(name, pattern, i + 1).alias(p) for i, p in enumerate(parts)]


def first_and_last(df: DataFrame, group: Sequence[str], order: Sequence[str], first: int, last: int) -> DataFrame:
    """Adds ``healthy``: the first rows of each group are, the last are not; the rest is left out."""
    from pyspark.sql import Window

    up = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    placed = df.withColumn("__up", up).withColumn("__n", n)
    healthy = F.col("__up") <= first
    return placed.where(healthy | (F.col("__up") > F.col("__n") - last)).withColumn("healthy", healthy).drop("__up", "__n")


def read_domains(spark: SparkSession, path: str, aliases: Mapping[str, str]) -> DataFrame:
    """``fault, domain`` from a JSON object of fault -> list of nodes, with renamed faults."""
    text = spark.read.option("wholetext", True).text(path)
    kind = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    rows = text.select(F.explode(F.from_json("value", kind)).alias("fault", "domain"))
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    fault = F.coalesce(F.try_element_at(names, F.col("fault")), F.col("fault")) if aliases else F.col("fault")
    return rows.select(fault.alias("fault"), "domain")


def write_dataset(df: DataFrame, path: str, metadata: Mapping[str, object], by: str = "client") -> None:
    """Windows as Parquet by client, with one JSON row of metadata next to them."""
    spark = df.sparkSession
    df.write.partitionBy(by).parquet(f"{path}/windows")
    row = {k: str(v) for k, v in metadata.items()}
    spark.createDataFrame([row], T.StructType([T.StructField(k, T.StringType()) for k in row])).coalesce(1).write.json(f"{path}/metadata")


def read_dataset(spark: SparkSession, path: str, drop: Sequence[str] = ()) -> DataFrame:
    return spark.read.parquet(f"{path}/windows").drop(*drop)


def read_prebuilt(spark: SparkSession, path: str, values: str, dead: Sequence[str] = (), nodes: str = "nodes") -> tuple[DataFrame, list[str]]:
    """The windows of a written dataset without the dead nodes, and the names of those that stay, in order.

    The metadata's ``nodes`` (a JSON list) names the entries of the array
    ``values``, one per node.  A dead node that the dataset lacks is an error,
    as is a window with another number of nodes.
    """
    row = spark.read.json(f"{path}/metadata").first()
    names = json.loads(row[nodes])
    unknown = sorted(set(dead) - set(names))
    if unknown:
        raise ValueError(f"not in the dataset: {unknown}")
    stay = [i for i, n in enumerate(names) if n not in set(dead)]
    windows = read_dataset(spark, path)
    wrong = F.raise_error(F.lit(f"a window without {len(names)} nodes"))
    kept = F.when(F.size(values) == len(names), F.array(*[F.col(values)[i] for i in stay])).when(F.col(values).isNotNull(), wrong)
    return windows.withColumn(values, kept), [names[i] for i in stay]


def write_report(metrics: DataFrame, path: str, by: Sequence[str]) -> None:
    """Metric rows as JSON, nested below the report keys."""
    leaf = [c for c in metrics.columns if c not in by]
    metrics.select(*by, F.struct(*leaf).alias("metrics")).write.json(path)
