"""Exact deduplication: group by a 128-bit hash, keep the smallest id, compare bytes.

The wide aggregate carries each distinct text once (copies collapse before the
shuffle), and only digests travel when the verdict is joined back to the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import SPACE_RUN, whole_text

#: Repeated rows that one array lists at most.
REPEATS = 10_000


def normalized(column: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(whole_text(column), SPACE_RUN, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped by ``hash_fn`` of the normalised text *and* by its bytes,
    so texts whose hashes collide stay apart.  The grouping combines copies in
    each map task, so a text that fills a third of the corpus reaches the
    shuffle as one row per task.

    A null text counts as empty.  A null id never stays while another id of
    its group does; a group of null ids only has a null ``keep_id``.  Exactly one
    row of a group is ``kept``: of rows that repeat both id and text one stays,
    and all count in ``group_size``.  An empty table gives an empty result.
    Other input columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), normalized(text_col).alias("content"))
    groups = (
        rows.groupBy(hash_fn(F.col("content")).alias("hash"), "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # Rows that repeat an id and a text are counted and written out again, so that one of them can stay.
    members = rows.groupBy(
        "doc_id", hash_fn(F.col("content")).alias("hash"), F.sha2("content", 256).alias("text_sha256")
    ).agg(F.count(F.lit(1)).alias("times"))
    block = lambda i: F.least(F.lit(REPEATS), F.col("times") - i * REPEATS)
    blocks = members.join(groups, ["hash", "text_sha256"]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))).alias("block")
    )
    out = blocks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), block(F.col("block")))).alias("nth"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("block") == 0) & (F.col("nth") == 1)
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that with the smallest id (null last), all columns unchanged.

    One aggregate over hash and bytes: copies collapse in the map tasks, and the
    text is read and normalised once.  Of rows that repeat the smallest id, any
    one stays.
    """
    content = normalized(text_col)
    place = F.struct(F.isnull(id_col).alias("last"), F.col(id_col).alias("id"))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    best = df.groupBy(content_hash(content).alias("__hash"), content.alias("__content")).agg(F.min_by(row, place).alias("__row"))
    return best.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(df.columns)])
