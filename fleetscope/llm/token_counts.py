"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary matches of a segment; the
dynamic programme over their ends carries the best score and its piece count.
Ties follow the tokenizer: a later candidate replaces only with a strictly
better score and candidates come by start, so the longest last piece wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import whole_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED = 500_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class CountViterbi:
    """Best score and piece count of texts.

    A character that starts no one-character piece is unknown: it costs the
    lowest piece score less ``UNKNOWN_PENALTY`` and counts one piece per UTF-8
    byte (byte fallback).  Scores are summed in double precision.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        inner = {c for piece, _ in pieces for c in piece if len(piece) > 1}
        marked_inside = any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        # No piece spans these boundaries, so the best paths of the segments are the best path of the text.
        breaks = "" if "\n" in inner else "\n"
        unit = rf"[{SPACE}]+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+" + ("|\n" if breaks else "")
        self.segments = re.compile("(?s).+" if marked_inside else unit).findall
        self.known: dict[str, tuple[int, float]] = {}

    def _best(self, text: str) -> tuple[int, float]:
        n, lowest = len(text), float("-inf")
        score, count = [0.0] + [lowest] * n, [0] * (n + 1)
        if self.single.issuperset(text):
            for last, (length, value) in self.matches.iter(text):
                end = last + 1
                start = end - length
                candidate = score[start] + value
                if candidate > score[end]:
                    score[end], count[end] = candidate, count[start] + 1
            return count[n], score[n]
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.matches.iter(text):
            found[last + 1].append(match)
        for end in range(1, n + 1):
            for length, value in sorted(found[end], reverse=True):
                candidate = score[end - length] + value
                if candidate > score[end]:
                    score[end], count[end] = candidate, count[end - length] + 1
            character = text[end - 1]
            if character not in self.single and score[end - 1] + self.unknown > score[end]:
                score[end] = score[end - 1] + self.unknown
                count[end] = count[end - 1] + len(character.encode())
        return count[n], score[n]

    def segment(self, text: str) -> tuple[int, float]:
        known = self.known.get(text)
        if known is None:
            known = self._best(text)
            if len(text) <= 48:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[text] = known
        return known

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; a space is put before it, as the tokenizer does."""
        if not text:
            return 0, 0.0
        pieces, score = 0, 0.0
        get = self.known.get
        for part in self.segments((SPACE + text.replace(" ", SPACE))):
            n, s = get(part) or self.segment(part)
            pieces += n
            score += s
        return pieces, score


_COUNTERS: dict[str, CountViterbi] = {}


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens`` and ``score`` of the best segmentation of the whole text.

    The pieces are read on the driver and broadcast (one vocabulary, about
    1 MB).  Null and empty texts have no tokens and score 0.  Rows never
    interact: repeated rows each get a row, an empty table gives none.
    """
    pieces = df.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    rows = df.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(model_path)
        if counter is None:
            counter = _COUNTERS[model_path] = CountViterbi(pieces.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [counter.count(text) for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                    names=["__id", "n_tokens", "score"],
                )

    counted = rows.mapInArrow(count, f"__id {kind}, n_tokens long, score double")
    return counted.withColumnRenamed("__id", id_col)
