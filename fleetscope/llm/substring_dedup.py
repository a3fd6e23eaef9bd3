"""Duplicate passages by relative Lempel-Ziv parsing over content-defined blocks.

Every window of ``WINDOW`` words is anchored at its smallest word 8-gram.  The
consecutive windows with one anchor form a block, the unit of the reference
index: its key is the anchor, its content the words of its windows.  Every block
of the corpus is indexed, and a document is parsed against all of them: a block
that occurs again as a whole refers to another occurrence, and the greedy parse
extends a factor over the blocks that follow in text and reference alike.  Where
only the anchor occurs again, a factor begins or ends inside the block, so the
windows of such boundary blocks are compared one by one, against each other and
against one occurrence of each repeated block, and extend the factors up to
their exact ends.  Equal windows have equal anchors, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import discard, materialize, row_key, whole_text
from fleetscope.llm.word_hashes import M1, chunks, hashed_words, mixed, runs

WINDOW = 35
ANCHOR = 8


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``values`` the place of its smallest value, the first of equals."""
    n = len(values) - width + 1
    place, low, span = np.arange(len(values)), values, 1
    while 2 * span <= width:
        later = low[span:] < low[:-span]
        place = np.where(later, place[span:], place[:-span])
        low = np.where(later, low[span:], low[:-span])
        span *= 2
    if span < width:
        shift = width - span
        later = low[shift : shift + n] < low[:n]
        place = np.where(later, place[shift : shift + n], place[:n])
    return place[:n]


def blocks_of(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk of texts: text index, first window (in the text), windows, anchor hash, content hash of each block."""
    for start, stop in chunks(column):
        words = hashed_words(column.slice(start, stop - start))
        total = len(words.hashes)
        if total < WINDOW:
            continue
        grams = runs(words.hashes, ANCHOR, salt=1)
        place = sliding_argmin(grams, WINDOW - ANCHOR + 1)
        text = np.repeat(np.arange(stop - start), np.diff(words.first))
        inside = text[: total - WINDOW + 1] == text[WINDOW - 1 :]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1 : len(place)] != text[: len(place) - 1])
        windows = np.flatnonzero(inside)
        if not len(windows):
            continue
        heads = np.flatnonzero(inside & new)
        count = np.diff(np.append(np.searchsorted(windows, heads), len(windows)))
        # The content is the sequence of window hashes, summed with a factor for the place in the block.
        whole = runs(words.hashes, WINDOW, salt=2)[windows]
        rank = np.arange(len(windows)) - np.repeat(np.searchsorted(windows, heads), count)
        content = np.add.reduceat(mixed(whole + rank.astype(np.uint64) * M1, 3), np.searchsorted(windows, heads))
        yield (
            start + text[heads],
            heads - words.first[text[heads]],
            count,
            grams[place[heads]],
            mixed(content ^ (heads - place[heads]).astype(np.uint64), 4),
        )


def index_blocks(rows: DataFrame) -> DataFrame:
    """``key, start, windows, anchor, content`` of every block of rows ``key, text``."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, start, count, anchor, content in blocks_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text)),
                        pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                    ],
                    names=["key", "start", "windows", "anchor", "content"],
                )

    return rows.select("key", "text").mapInArrow(run, f"key {kind}, start int, windows int, anchor long, content long")


def windows_in(rows: DataFrame) -> DataFrame:
    """``key, start, w1, w2`` (128 bits) for each window in the ``ranges`` of rows ``key, text, ranges``."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ranges = batch.column(1), batch.column(2).to_pylist()
            for begin, stop in chunks(column):
                words = hashed_words(column.slice(begin, stop - begin))
                texts, starts = [], []
                for d in range(begin, stop):
                    for r in ranges[d]:
                        starts.append(np.arange(r["start"], r["start"] + r["windows"]))
                        texts.append(np.full(r["windows"], d))
                text, start = np.concatenate(texts), np.concatenate(starts)
                at = words.first[text - begin] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text)),
                        pa.array(start.astype(np.int32)),
                        *[pa.array(runs(words.hashes, WINDOW, salt=s)[at].view(np.int64)) for s in (5, 6)],
                    ],
                    names=["key", "start", "w1", "w2"],
                )

    return rows.select("key", "text", "ranges").mapInArrow(run, f"key {kind}, start int, w1 long, w2 long")


REFERENCE = "struct<key:struct<a:bigint,b:bigint>,start:int>"
RANGES = f"array<struct<start:int,windows:int,reference:{REFERENCE}>>"


def _with_ranges(rows: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """Rows with the ranges of their key; rows of one key have the same text, so each range is listed once."""
    columns = [c for c in ("start", "windows", "reference") if c in ranges.columns]
    per_key = ranges.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("ranges"))
    return rows.join(materialize(per_key, "ranges"), "key", how)


def _elsewhere() -> Column:
    """A place of the same content other than the row's own, out of the first and the last one."""
    own = F.struct("key", "start")
    return F.when(F.col("first") == own, F.col("last")).otherwise(F.col("first")).alias("reference")


def duplicate_windows(rows: DataFrame) -> DataFrame:
    """``key, start, windows, reference``: ranges of window starts whose words also start at the reference."""
    blocks = materialize(index_blocks(rows), "blocks")
    counted = blocks.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")
    )
    anchors = materialize(
        counted.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors"
    )
    met = materialize(blocks.join(anchors, "anchor"), "met-blocks")
    discard(blocks)
    place = F.struct("key", "start")
    contents = met.groupBy("anchor", "content", "mixed").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.min("windows").alias("windows")
    )
    contents = materialize(contents, "contents")
    repeated = contents.where("n > 1").select("anchor", "content", "first", "last")
    factors = met.join(repeated, ["anchor", "content"]).select("key", "start", "windows", _elsewhere())
    # One occurrence of every block whose anchor has several contents stands for the rest.
    boundary = contents.where("mixed").select("first.key", "first.start", "windows")
    looked_at = windows_in(_with_ranges(rows, boundary, "inner"))
    seen = materialize(looked_at, "boundary-windows")
    twice = seen.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    twice = materialize(twice.where("n > 1").drop("n"), "twice")
    edges = seen.join(twice, ["w1", "w2"]).select("key", "start", F.lit(1).alias("windows"), _elsewhere())
    return factors.unionByName(edges)


def greedy_factors(ranges: list[dict]) -> list[tuple[int, int]]:
    """(first word, words) of the factors of one text, from its ranges sorted by start.

    A factor begins at the first window that is in no factor yet, along the
    range that reaches farthest, and goes on, block by block and at its
    boundaries window by window, as long as the words at its reference go on
    too; where they end, the next factor begins.  Every range seen so far stays
    a candidate until it is passed, so the factors cover all ranges.
    """
    factors: list[list[int]] = []
    end, line, seen = -1, None, 0  # the next window, and the factor's line: its reference less its own place
    stops: dict[tuple, int] = {}  # per line the farthest end of the ranges that begin up to ``end``
    widest, beyond = None, -1  # the line that reaches farthest
    while True:
        while seen < len(ranges) and ranges[seen]["start"] <= end:
            r = ranges[seen]
            seen += 1
            key, stop = r["reference"]["key"], r["start"] + r["windows"]
            along = (key["a"], key["b"], r["reference"]["start"] - r["start"])
            stops[along] = max(stop, stops.get(along, -1))
            if stop > beyond:
                widest, beyond = along, stop
        if line is not None and stops[line] > end:
            factors[-1][1] += stops[line] - end
            end = stops[line]
        elif beyond > end:
            line = widest
            factors.append([end, beyond - end])
            end = beyond
        elif seen < len(ranges):
            end, line = ranges[seen]["start"], None
        else:
            return [(start, windows + WINDOW - 1) for start, windows in factors]


def covered_words(factors: list[tuple[int, int]], n_words: int) -> np.ndarray:
    """Mask of the words under any factor."""
    change = np.zeros(n_words + 1, np.int64)
    for start, words in factors:
        change[start] += 1
        change[start + words] -= 1
    return np.cumsum(change[:n_words]) > 0


def remove_duplicate_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``n_factors``, ``kept_text`` (the kept words joined by one space).

    A word goes if a window of ``WINDOW`` words that covers it also starts
    anywhere else, in the same or another document; all occurrences go.  The
    windows of the input decide, not what is left.  Texts with fewer words, null
    and empty texts lose nothing.  Every row is a document of its own, also
    where ids repeat or are null: rows are told apart by 128 bits of id and text,
    and rows equal in both are copies of each other.  An empty table gives an
    empty result.  Words are compared by 64-bit hashes and windows by 128 bits
    of these, so two of ``n`` distinct words are taken for one with odds of
    n^2 / 2^65 (3e-5 for 30 million distinct words).
    """
    rows = df.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    marked = _with_ranges(rows, duplicate_windows(rows), "left")
    marked = marked.select("id", "text", F.coalesce("ranges", F.array().cast(RANGES)).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                counts, removed, n_factors, texts = [], [], [], []
                for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                    words = text.as_buffer().to_pybytes().split()
                    counts.append(len(words))
                    factors = greedy_factors(ranges.as_py()) if len(ranges) else []
                    n_factors.append(len(factors))
                    if factors:
                        gone = covered_words(factors, len(words))
                        removed.append(int(gone.sum()))
                        words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
                    else:
                        removed.append(0)
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), *[pa.array(column, pa.int64()) for column in (counts, removed, n_factors)],
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["__id", "n_words", "n_removed", "n_factors", "kept_text"],
                )

    out = marked.mapInArrow(run, f"__id {kind}, n_words long, n_removed long, n_factors long, kept_text string")
    return out.withColumnRenamed("__id", id_col)
