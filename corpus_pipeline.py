"""Corpus preparation: five stages over ``documents``, each a Spark job of its own."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.byte_bpe import encode_documents
from fleetscope.llm.common import documents, materialize, row_key
from fleetscope.llm.exact_dedup import drop_exact_duplicates
from fleetscope.llm.ngram_join import one_of_each_component
from fleetscope.llm.quality_rules import good_documents
from fleetscope.llm.source_mix import mix_sources

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row is judged by its own text."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shingle links connect."""
    return one_of_each_component(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it; rows equal in id, text and source all get their largest number of copies."""
    keyed = docs.withColumn("__key", row_key("doc_id", "text", "source"))
    copies = mix_sources(keyed, id_col="__key").groupBy("__key").agg(F.max("copies").alias("__copies"))
    taken = keyed.join(copies, "__key").where("__copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_documents(docs, ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(*docs.columns, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
