"""Packing of token sequences by bin completion with branch and bound.

Documents become pieces of at most ``limit`` tokens.  Pieces are dealt to blocks
of bounded size, and each block is packed on its own: around its largest piece a
sequence is completed with each undominated filling in turn, least waste first;
branches whose waste rules out a packing better than the best known one are cut,
and best-fit packings serve as the best known ones.  The least filled sequence of
every block is opened again and its pieces meet those of other blocks in a
further level, until a level has one block.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.common import discard, materialize
from fleetscope.llm.token_alignment import Pool

#: Pieces of a block, about.
BLOCK = 4000
#: Fillings that a block may try beyond two for each of its sequences; then the best known packing stands.
TRIES = 2000
#: Distinct words that a task remembers, and the longest of them.
CACHED, LONG = 500_000, 60


def best_fit(counts: list[int], limit: int) -> list[list[int]]:
    """Sequences of lengths: longest first, each into the fullest sequence that still has room."""
    sequences: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0  # bit r: some sequence has room r
    for length in range(limit, 0, -1):
        for _ in range(counts[length]):
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                at = with_room[room].pop()
                if not with_room[room]:
                    mask ^= 1 << room
            else:
                room, at = limit, len(sequences)
                sequences.append([])
            sequences[at].append(length)
            if room > length:
                with_room[room - length].append(at)
                mask |= 1 << room - length
    return sequences


def least_sequences(counts: list[int], limit: int) -> int:
    """A lower bound: pieces over half the limit are apart, and what fits beside none of them needs room of its own."""
    n = np.array(counts, np.int64)
    many, tokens = np.cumsum(n), np.cumsum(n * np.arange(limit + 1))
    bound = -(-int(tokens[-1]) // limit)
    half = limit // 2
    for k in range(half + 1):
        over = int(many[-1] - many[limit - k])
        large, large_tokens = int(many[limit - k] - many[half]), int(tokens[limit - k] - tokens[half])
        small = int(tokens[half] - (tokens[k - 1] if k else 0))
        bound = max(bound, over + large + max(0, -(-(small - (large * limit - large_tokens)) // limit)))
    return bound


class _Search:
    """Depth-first search over completions of the largest remaining piece."""

    def __init__(self, counts: list[int], limit: int):
        self.counts, self.limit = list(counts), limit
        self.best = best_fit(counts, limit)
        self.bound = least_sequences(counts, limit)
        self.tokens = sum(length * n for length, n in enumerate(counts))
        self.mask = sum(1 << length for length, n in enumerate(counts) if n)
        self.tries = 2 * len(self.best) + TRIES
        self.waste = 0

    def allowed(self) -> int:
        """Waste that a packing with one sequence less than the best known one may still add."""
        return (len(self.best) - 1) * self.limit - self.tokens - self.waste

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.mask ^= 1 << length

    def give(self, length: int) -> None:
        if not self.counts[length]:
            self.mask |= 1 << length
        self.counts[length] += 1

    def dominated(self, filling: list[int], waste: int) -> bool:
        """Whether a spare piece fits beside the filling, or in the place of a smaller piece or of several, within the waste."""
        ones, more, spare = 0, 0, self.mask
        for length in filling:
            more |= (more | ones) << length
            ones |= 1 << length
        for length in set(filling):
            if self.counts[length] == filling.count(length):
                spare ^= 1 << length
        reach, width = more, 1
        while width <= waste:  # sums of several, and up to ``waste`` above them
            step = min(width, waste + 1 - width)
            reach |= reach << step
            width += step
        if reach & spare:
            return True
        singles = (1 << waste + 1) - 1  # beside all of them
        for length in set(filling):
            singles |= ((1 << waste) - 1) << length + 1
        return bool(singles & spare)

    def fillings(self, room: int) -> Iterator[tuple[list[int], int]]:
        """Undominated fillings of ``room`` with their waste, least waste first; fewer and larger pieces first."""
        if room and self.counts[room]:
            yield [room], 0  # one piece that fits exactly dominates all others
            return
        inside = self.mask & ((1 << room + 1) - 1)
        lengths = [i for i, bit in enumerate(bin(inside)[:1:-1]) if bit == "1"] if inside else []
        cut, reach = (1 << room + 1) - 1, [1]  # reach[k]: sums of pieces of the first k lengths
        for length in lengths:
            sums, left, step = reach[-1], min(self.counts[length], room // length), 1
            while left:
                step = min(step, left)
                sums |= sums << length * step & cut
                left -= step
                step *= 2
            reach.append(sums)

        def exact(total: int, k: int) -> Iterator[list[int]]:
            if not total:
                yield []
                return
            for j in range(min(k, bisect_right(lengths, total)) - 1, -1, -1):
                if not reach[j + 1] >> total & 1:
                    return
                length = lengths[j]
                for n in range(min(self.counts[length], total // length), 0, -1):
                    if reach[j] >> total - n * length & 1:
                        for rest in exact(total - n * length, j):
                            yield [length] * n + rest

        sums = reach[-1]
        while sums:
            total = sums.bit_length() - 1
            if room - total > self.allowed():
                return
            for filling in exact(total, len(lengths)):
                self.tries -= 1
                if self.tries < 0 or not self.dominated(filling, room - total):
                    yield filling, room - total
                if room - total > self.allowed():
                    return
            sums ^= 1 << total

    def run(self) -> list[list[int]]:
        chosen: list[tuple[list[int], int]] = []
        stack: list[Iterator] = []
        while len(self.best) > self.bound:
            if not self.mask:
                self.best = [sequence for sequence, _ in chosen]
            elif self.tries >= 0:
                largest = self.mask.bit_length() - 1
                self.take(largest)
                stack.append(self.fillings(self.limit - largest))
                chosen.append(([largest], 0))
            else:  # out of tries: best-fit completes the branch
                rest = best_fit(self.counts, self.limit)
                if len(chosen) + len(rest) < len(self.best):
                    self.best = [sequence for sequence, _ in chosen] + rest
                return self.best
            while stack:  # the next filling of the deepest open sequence
                sequence, waste = chosen[-1]
                for length in sequence[1:]:
                    self.give(length)
                self.waste -= waste
                chosen[-1] = (sequence[:1], 0)
                found = next(stack[-1], None)
                if found is not None:
                    filling, waste = found
                    for length in filling:
                        self.take(length)
                    self.waste += waste
                    chosen[-1] = ([sequence[0], *filling], waste)
                    break
                self.give(sequence[0])
                stack.pop()
                chosen.pop()
            if not stack:
                return self.best
        return self.best


def pack_lengths(counts: list[int], limit: int) -> list[list[int]]:
    """Few sequences of at most ``limit`` for ``counts[length]`` pieces of each length from 1 to ``limit``."""
    full = counts[limit]
    rest = [*counts[:limit], 0]
    return [[limit]] * full + _Search(rest, limit).run()


def place_pieces(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece its sequence and offset; per sequence its tokens."""
    sequences = pack_lengths(np.bincount(lengths, minlength=limit + 1).tolist(), limit)
    order = np.argsort(lengths, kind="stable")
    following = np.searchsorted(lengths[order], np.arange(limit + 2)).tolist()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, members in enumerate(sequences):
        at = 0
        for length in members:
            piece = order[following[length]]
            following[length] += 1
            sequence[piece], offset[piece] = k, at
            at += length
    return sequence, offset, np.array([sum(m) for m in sequences], np.int64)


#: The normaliser and pre-tokenizer for which texts can be taken apart into words (fixed values).
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Characters on which the normaliser only changes case, and that pattern's words among them in lower case.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
SPACE = re.compile("[\t-\r ]+")


class WordCoder:
    """Ids of whole texts as the tokenizer gives them, with each distinct word encoded once.

    The pattern's words never span white space, so a text is the sequence of
    its words.  Plain texts are lower-cased and split here; their words go to
    the tokenizer's model alone, joined by spaces, and a token that closes a
    word shows where the next begins.  Other runs between white space go
    through the whole tokenizer.  A tokenizer of another kind gets whole texts.
    """

    def __init__(self, raw: str):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(raw)
        self.whole = Tokenizer.from_str(raw)
        self.by_words = all(spec[k] == v for k, v in WORDS.items()) and spec["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bare = Tokenizer.from_str(raw)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = Pool()

    def _parts(self, text: str) -> list[str]:
        """The words of a text; what the whole tokenizer must see begins with a newline."""
        if not self.by_words:
            return ["\n" + text] if text else []
        marked = any(mark in text for mark in self.special)
        if not marked and PLAIN.fullmatch(text):
            return PLAIN_WORD.findall(text.lower())
        parts: list[str] = []
        for run in SPACE.split(text):
            if PLAIN.fullmatch(run) and not (marked and any(mark in run for mark in self.special)):
                parts += PLAIN_WORD.findall(run.lower())
            elif run:
                parts.append("\n" + run)
        return parts

    def _learn(self, words: list[str]) -> None:
        plain, others = [w for w in words if w[0] != "\n"], [w for w in words if w[0] == "\n"]
        joined = [" ".join(plain[i : i + 2000]) for i in range(0, len(plain), 2000)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)), np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("a word without its closing token")
        self.pool.append(ids.astype(np.int32), np.diff(ends, prepend=0))
        lists = [e.ids for e in self.whole.encode_batch_fast([w[1:] for w in others], add_special_tokens=False)]
        self.pool.append(np.fromiter(chain.from_iterable(lists), np.int32), np.array(list(map(len, lists)), np.int64))
        self.known.update(zip([*plain, *others], range(len(self.pool.size) - len(words), len(self.pool.size)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where each text's begin."""
        parts = list(map(self._parts, texts))
        flat = list(chain.from_iterable(parts))
        new = set(flat).difference(self.known)
        if len(self.pool.size) + len(new) > CACHED:
            self._forget()
            new = set(flat)
        if new:
            self._learn(list(new))
        places = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        for word in [w for w in new if len(w) > LONG]:
            del self.known[word]
        return self.pool.taken(places, np.concatenate([[0], np.cumsum(list(map(len, parts)), dtype=np.int64)]).astype(np.int64))


_CODERS: dict[str, WordCoder] = {}


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, limit: int, end_id: int, keep_ids: bool) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` and, on request, ``ids``: a document's ids and ``end_id``, cut every ``limit``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, 1.7 MB
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [rows.schema["id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _CODERS:
            _CODERS[tokenizer_path] = WordCoder(shared.value)
        coder = _CODERS[tokenizer_path]
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                coded, bounds = coder.encode([t or "" for t in batch.column(1).to_pylist()])
                bounds = bounds.tolist()
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    data = coded[a:b].astype("<u4").tobytes() + end
                    for k, first in enumerate(range(0, len(data), 4 * limit)):
                        part = data[first : first + 4 * limit]
                        at.append(i)
                        piece.append(k)
                        start.append(first // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _packer(limit: int, several: bool, names: list[str]):
    """A function that packs the table of one block; where there are several, its least filled sequence is marked open."""

    def packed(table: pa.Table) -> pa.Table:
        sequence, offset, tokens = place_pieces(table.column("length").to_numpy(), limit)
        least = int(np.argmin(tokens))
        again = (sequence == least) & several & (tokens[least] < limit)
        for name, values in (("__at", sequence), ("offset", offset), ("__open", again)):
            table = table.append_column(name, pa.array(values))
        return table.select(names)

    return packed


def pack_pieces(pieces: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """All rows and columns of a written table with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``limit``.

    Pieces are dealt to blocks by the hash of a number that the written table
    fixes, so equal rows spread as well.
    """
    names = pieces.columns
    waiting = materialize(pieces.withColumn("__number", F.monotonically_increasing_id()), "pieces")
    written, done = waiting, []
    for level in range(16):
        blocks = max(1, round(waiting.count() / block))
        place = F.pmod(F.xxhash64("__number", F.lit(level)), F.lit(blocks)).cast("long")
        added = (T.StructField("__at", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__open", T.BooleanType()))
        schema = T.StructType([T.StructField("__block", T.LongType()), *waiting.schema.fields, *added])
        dealt = waiting.select(place.alias("__block"), "*").groupBy("__block")
        found = materialize(dealt.applyInArrow(_packer(limit, blocks > 1, schema.names), schema), "packed")
        if level == 0:
            discard(written)
        number = F.lit(level << 58) + F.shiftleft("__block", 24) + F.col("__at")
        done.append(found.where("not __open").select(*names, number.alias("sequence_id"), "offset"))
        waiting = found.where("__open").select(*names, "__number")
        if blocks == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, on request, ``ids``.

    A document is its ids, special tokens not added, and ``end_id``.  Only a
    document longer than ``limit`` is cut, and only its last piece may be
    shorter.  A null or empty text is the end id alone.  Pieces of a sequence
    lie side by side from offset 0.  Every row is a document of its own, also
    where ids are null or repeat; an empty table gives an empty result.  The
    packing depends on how the input is split, its size hardly does.
    """
    pieces = token_pieces(df, tokenizer_path, id_col, text_col, limit, end_id, keep_ids)
    return pack_pieces(pieces, limit, block).withColumnRenamed("id", id_col)
