"""Fill-in-middle transformation with a learned rank index over line boundaries.

The boundaries of a text's lines are its only places to cut.  Their offsets are
indexed by rank: greedy segments of straight lines, none farther than ``ERROR``
code points from any offset it covers, predict the offset of a rank, and the
residual stored for that rank corrects the prediction exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest distance of a prediction from the offset; residuals then fit a byte.
ERROR = 100
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


@dataclass
class RankIndex:
    """Segment ``i`` predicts ``base[i] + slope[i] * (rank - first[i])`` from rank ``first[i]`` on."""

    first: list[int]
    base: list[int]
    slope: list[float]
    residual: np.ndarray

    def predicted(self, rank: int) -> int:
        i = bisect_right(self.first, rank) - 1
        return self.base[i] + round(self.slope[i] * (rank - self.first[i]))

    def offset(self, rank: int) -> int:
        """The exact offset of the boundary with this rank."""
        return self.predicted(rank) + int(self.residual[rank])


def fit_index(offsets: Sequence[int], error: int = ERROR) -> RankIndex:
    """Segments as long as one line through their first point stays within ``error`` of all their points.

    A segment keeps the range of slopes that its points allow and ends before
    the first point that leaves none; its slope is the middle of that range.
    """
    first: list[int] = []
    base: list[int] = []
    slope: list[float] = []
    rank, n = 0, len(offsets)
    while rank < n:
        start, origin = rank, offsets[rank]
        low, high = float("-inf"), float("inf")
        rank += 1
        while rank < n:
            run, rise = rank - start, offsets[rank] - origin
            least, most = max(low, (rise - error) / run), min(high, (rise + error) / run)
            if least > most:
                break
            low, high = least, most
            rank += 1
        first.append(start)
        base.append(origin)
        slope.append((low + high) / 2 if rank - start > 1 else 0.0)
    index = RankIndex(first, base, slope, np.zeros(n, np.int64))
    residual = np.array([offsets[k] - index.predicted(k) for k in range(n)], np.int64)
    index.residual = residual.astype(np.min_scalar_type(-error - 1))
    return index


def line_ends(text: str) -> list[int]:
    """0 and the code point offset behind each line; the last line may lack its newline."""
    ends = [0, *(m.end() for m in re.finditer("\n", text))]
    if ends[-1] < len(text):
        ends.append(len(text))
    return ends


def _draws(id_col: str, seed: int) -> list[Column]:
    """The first four 32-bit groups of the hex SHA-256 of ``<seed>:<id>``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__draw{k}") for k in range(4)]


def line_index(df: DataFrame, text_col: str = "text", error: int = ERROR) -> DataFrame:
    """All rows and columns of ``df`` with ``segments`` (rank, offset, slope) and ``residuals`` of the text's boundaries.

    A null or empty text has the single boundary 0.  Columns of these names are replaced.
    """
    df = df.drop("segments", "residuals")
    segment = T.StructType([T.StructField("rank", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("slope", T.DoubleType())])
    added = [T.StructField("segments", T.ArrayType(segment)), T.StructField("residuals", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*df.schema.fields, *added])
    at, names = df.columns.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())])), pa.list_(pa.int32())
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [fit_index(line_ends(t or ""), error) for t in batch.column(at).to_pylist()]
                segments = [[{"rank": r, "offset": b, "slope": s} for r, b, s in zip(i.first, i.base, i.slope, strict=True)] for i in found]
                columns = [pa.array(segments, kinds[0]), pa.array([i.residual.tolist() for i in found], kinds[1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return df.mapInArrow(run, schema)


ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, error: int = ERROR
) -> DataFrame:
    """All rows and columns of ``df`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The units are lines.  Two draws from the id choose boundaries: the prefix
    ends at the smaller, the middle at the larger.  ``percent`` of the texts are
    transformed, ``spm_percent`` of these with the suffix first (``spm``), the
    rest with the prefix first (``psm``).  An empty or null text and a text
    that contains a sentinel stay as they are (``plain``), with null lengths.
    Rows never interact, so repeated rows give repeated results; rows with one
    id share their draws.  Existing columns with the new names are replaced.
    """
    df = df.drop(*ADDED)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))])
    at, width, names = df.columns.index(text_col), len(df.columns), schema.names
    p, s, m = SENTINELS

    def transformed(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        ends = line_ends(text)
        n = len(ends) - 1
        if not text or h3 % 100 >= percent or any(mark in text for mark in SENTINELS):
            return n, "plain", None, None, text
        index = fit_index(ends, error)
        one, two = h1 % (n + 1), h2 % (n + 1)
        a, b = index.offset(min(one, two)), index.offset(max(one, two))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                draws = [batch.column(width + k).to_pylist() for k in range(4)]
                rows = [transformed(t or "", *h) for t, *h in zip(batch.column(at).to_pylist(), *draws, strict=True)]
                added = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], names=names)

    return df.select("*", *_draws(id_col, seed)).mapInArrow(run, schema)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds ``restored``, the text rebuilt from output and form alone.

    A transformed text holds no sentinel, and none can arise across a seam, so
    splitting at the sentinels gives back exactly the three parts.
    """
    p, s, m = (re.escape(mark) for mark in SENTINELS)
    body = F.substr(output_col, F.lit(len(SENTINELS[0]) + 1))
    psm, spm = F.split(body, f"{s}|{m}", -1), F.split(body, f"{p}|{m}", -1)
    text = (
        F.when(F.col(form_col) == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(F.col(form_col) == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(F.col(output_col))
    )
    return df.withColumn("restored", text)
