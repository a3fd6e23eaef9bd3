"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_TABLES: dict[int, tuple[weakref.ref, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, as all its tasks
    run on this machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="fleetscope-"))


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path there, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, system = _hadoop_path(spark, path)
    system.deleteOnExit(at)
    return path


#: Whether a query's shuffle files go as soon as it ends, rather than when the driver's JVM next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet and read back.

    This cuts the lineage; the files are on storage that every executor sees,
    so a lost executor costs at most its running tasks.  The shuffle files of
    the write go at once, as nothing reads them again.  ``discard`` removes the
    table, at the latest the end of the driver's JVM does.

    Readers hold the values of one row group at least; ``group_rows`` limits its
    rows, for tables whose rows are large.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        write = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
        write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(table)] = (weakref.ref(table), path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no DataFrame still to be evaluated reads."""
    for table in tables:
        known, path = _TABLES.pop(id(table), (lambda: None, ""))
        if known() is table:
            at, system = _hadoop_path(table.sparkSession, path)
            system.delete(at, True)
