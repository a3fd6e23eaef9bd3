"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.plans.storage import discard
from fleetscope.plans.storage import stored as materialize

__all__ = ["SPACES", "SPACE_RUN", "WORD", "discard", "documents", "materialize", "row_key", "whole_text"]

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(*columns: str | Column) -> Column:
    """128 bits that name a row by the values of ``columns``, nulls included; rows equal in all of them share it."""
    marked = [F.struct(F.isnull(c).alias("none"), (F.col(c) if isinstance(c, str) else c).alias("value")) for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(*marked, F.lit(2)).alias("b"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
