"""Mixing sources to target weights with the cube method.

A source whose target is ``r`` times its size takes every document ``floor(r)``
times and some of them once more.  Which ones is a balanced sample with equal
inclusion probabilities ``r - floor(r)``: probabilities move along the null
space of the constraints (documents, tokens) until all but a few are 0 or 1.
The flight runs in salted blocks of a source; what a block leaves open, at most
two documents, meets in the next level's blocks, and the last level lands.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import WORD, materialize, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 500
FAN_IN = 200
#: A unit is large if so many of it would hold more than all smaller ones.
LARGE = 200
EDGE = 1e-9


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source: source_size, n_docs, target.

    Weights repeat over the sources by code point, null last.  The targets share
    the sum of all sizes by weight; a source stops at ``most`` times its size
    and the excess goes to the others, so every target is the smaller of its
    cap and ``level * weight``.  ``level`` is found with running sums over the
    sources ordered by cap per weight; that window holds one row per source.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn(
        "weight", F.element_at(choice, (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped_before) / F.sum("weight").over(
        order.rowsBetween(0, Window.unboundedFollowing)
    )
    levels = weighed.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    first_free = F.min(
        F.when(F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12), F.struct("place", "level"))
    ).over(everything)
    return levels.withColumn("free", first_free).select(
        "source",
        "source_size",
        "n_docs",
        F.least(F.col("cap"), F.col("free.level") * F.col("weight")).alias("target"),
    )


def settle_large(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> int:
    """Decide units, largest first, that hold much of what the others do; returns how many, and changes ``p``.

    Each goes to 0 or 1 and all later ones shift alike to keep sum(p * size), so
    no such unit is left for the landing.  A unit that the later ones cannot
    make up for ends this.
    """
    rest = float(size.sum())
    for k in range(len(p) - 3):
        rest -= size[k]
        if size[k] * LARGE <= rest or not EDGE < p[k] < 1 - EDGE:
            return k
        up, down = (1 - p[k]) * size[k] / max(rest, 1.0), p[k] * size[k] / max(rest, 1.0)
        if up >= p[k + 1 :].min() or down >= 1 - p[k + 1 :].max():
            return k
        taken = draws[k] < p[k]
        p[k] = float(taken)
        p[k + 1 :] += -up if taken else down
    return 0


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` towards 0 and 1 with sum(p) and sum(p * size) unchanged; at most two stay between.

    ``size`` descends.  Units of very large size are settled first, at the cost of sum(p).
    """
    p = p.copy()
    pool: list[int] = []
    draws = rng.random(4 * len(p) + 8)
    used = len(p)
    for unit in (*range(settle_large(p, size, draws), len(p)), -1):
        if unit >= 0:
            if p[unit] < EDGE or p[unit] > 1 - EDGE:
                p[unit] = round(p[unit])
                continue
            pool.append(unit)
        while len(pool) >= 3 or (unit < 0 and len(pool) == 2 and size[pool[0]] == size[pool[1]]):
            s = [float(size[i]) for i in pool[:3]]
            move = [s[2] - s[1], s[0] - s[2], s[1] - s[0]] if len(s) == 3 else [1.0, -1.0]
            if not any(move):
                move = [1.0, -1.0, 0.0]
            up = min((1 - p[i]) / m if m > 0 else -p[i] / m for i, m in zip(pool, move, strict=True) if m)
            down = min(p[i] / m if m > 0 else (p[i] - 1) / m for i, m in zip(pool, move, strict=True) if m)
            step = up if draws[used] * (up + down) < down else -down
            used += 1
            for i, m in zip(pool, move, strict=True):
                p[i] += step * m
                if p[i] < EDGE or p[i] > 1 - EDGE:
                    p[i] = round(p[i])
            pool = [i for i in pool if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The corner with totals nearest to the balanced ones: tokens first, then documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best, answer = None, p
    for corner in range(2 ** len(left)):
        q = p.copy()
        q[left] = [(corner >> k) & 1 for k in range(len(left))]
        off = (abs(float(((q - p) * size).sum())), abs(float((q - p).sum())))
        if best is None or off < best:
            best, answer = off, q
    return answer


def _level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One level of the flight; in each block rows are ordered by size and hash, so reruns agree."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("mixed", "descending")])
        rng = np.random.default_rng([seed, level, block["place"][0].as_py(), block["block"][0].as_py()])
        size = block["size"].to_numpy().astype(float)
        p = flight(block["p"].to_numpy(), size, rng)
        return block.set_column(block.column_names.index("p"), "p", pa.array(land(p, size) if last else p))

    shrunk = rows.withColumn("block", F.floor(F.col("block") / FAN_IN)) if level else rows
    return shrunk.groupBy("place", "block").applyInArrow(run, rows.schema)


def _salted(rows: DataFrame) -> DataFrame:
    """``mixed``, a hash that deals rows to blocks: of source, id and text, and of a number where many rows share these.

    Which of equal rows gets which number does not matter, as long as the
    numbers are 0, 1, ..: the result is the same however the input is split.
    """
    named = rows.withColumn("mixed", F.xxhash64("place", "doc_id", "mark")).drop("mark")
    many = materialize(named.groupBy("mixed").count().where(F.col("count") > BLOCK // 2).select("mixed"), "mix-many")
    if many.isEmpty():
        return named
    equal = materialize(named.join(many, "mixed").withColumn("part", F.spark_partition_id()), "mix-equal")
    counts = equal.groupBy("mixed", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("mixed").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mixed", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("mixed", "part").orderBy("place"))
    numbered = equal.withColumn("inside", inside).join(offsets, ["mixed", "part"])
    salted = numbered.withColumn("mixed", F.xxhash64("mixed", F.col("inside") + F.col("before"))).select(named.columns)
    return named.join(many, "mixed", "left_anti").select(named.columns).unionByName(salted)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = 3.0,
    seed: int = 0,
) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target`` (its source's), ``copies``, ``taken``.

    ``taken`` is ``size * copies``, at most ``most`` times the size (for an
    integer ``most``).  Rows without words have copies 1 and take nothing.  A
    null source is the last source; a null text has no words; rows with null or
    repeated ids are sampled as rows of their own, and ids of any type pass
    through unchanged.  A source without words has
    target 0.  An empty table gives an empty result.
    """
    sizes = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(text_col).alias("mark"),
    )
    sizes = materialize(sizes, "mix-sizes")
    named = materialize(source_targets(sizes, weights, most).withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = named.withColumn("whole", F.floor(ratio + EDGE)).withColumn(
        "p", F.greatest(ratio - F.col("whole"), F.lit(0.0))
    )
    right = named.withColumnRenamed("source", "__source")
    rows = sizes.join(right, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "size", "source_size", "target", "whole", "p", "place", "n_docs", "mark"
    )
    rows = _salted(rows)
    blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK), F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.col("mixed"), blocks)).drop("n_docs")
    chosen = (F.col("size") > 0) & (F.col("p") > EDGE)
    fixed = rows.where(~chosen).withColumn("p", F.lit(0.0))
    largest = named.agg(F.max("n_docs")).first()[0] or 0
    levels = 1 + max(0, math.ceil(math.log(max(1.0, largest / BLOCK), FAN_IN)))
    done, open_rows = [fixed], rows.where(chosen)
    for level in range(levels):
        last = level == levels - 1
        flown = materialize(_level(open_rows, level, last, seed), "mix-flight")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown if last else flown.where(~still))
        open_rows = flown.where(still)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p")).otherwise(1).cast("int")
    return out.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )
