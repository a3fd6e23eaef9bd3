"""Alignment of two tokenizers by products of token-byte incidence matrices.

For a run of texts, ``A`` and ``B`` have a row per token and a column per byte.
``A B'`` then holds, for each pair of tokens, the number of bytes they share:
its entries are the overlap links.  Offsets where tokens of both end cut the
tokens into groups; the product of the two token-group incidence matrices holds
the pairs of tokens that share a group.  The matrices are plain CSR arrays and
the products row by row: a row of the product is the sum of the right-hand rows
that the left-hand row picks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.common import materialize

#: Bytes of text whose matrices are built at once; a longer single text is a run of its own.
RUN = 1_000_000
#: Bytes of text whose distinct pairs are counted together before they are shuffled.
CHUNK = 8_000_000
#: A single space with a visible character on both sides.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Parts of texts that a task remembers, and the longest of them.
CACHED, LONG = 500_000, 60
#: Entries of a product that are expanded at once.
BLOCK = 4_000_000


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ..`` for ``lengths[i]`` places, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(starts) else starts, lengths)
    return np.arange(total) + shift


@dataclass
class CSR:
    """A sparse matrix: row ``i`` has ``values[k]`` in ``columns[k]`` for ``first[i] <= k < first[i + 1]``."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def incidence(cls, first: np.ndarray, columns: np.ndarray, width: int) -> CSR:
        return cls(first, columns, np.ones(len(columns), np.int64), width)

    @property
    def height(self) -> int:
        return len(self.first) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.first))

    def transposed(self) -> CSR:
        order = np.argsort(self.columns, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return CSR(first, self.rows()[order], self.values[order], self.height)

    def fan(self, other: CSR) -> np.ndarray:
        """Per entry the entries of ``other`` that it meets in a product."""
        return np.diff(other.first)[self.columns]

    def met(self, other: CSR) -> np.ndarray:
        """Per row the entries met in the product with ``other``, equal columns counted each time."""
        sums = np.concatenate([[0], np.cumsum(self.fan(other))])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def product(self, other: CSR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``row, column, value`` of the product's entries by row and column, in blocks of about ``BLOCK`` expanded ones."""
        upto = np.cumsum(self.met(other))
        start = 0
        while start < self.height:
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
            picked = slice(self.first[start], self.first[stop])
            columns = self.columns[picked]
            fan = np.diff(other.first)[columns]
            at = spans(other.first[columns], fan)
            row = np.repeat(np.repeat(np.arange(start, stop), np.diff(self.first[start : stop + 1])), fan)
            column, value = other.columns[at], np.repeat(self.values[picked], fan) * other.values[at]
            place = row * other.width + column
            if len(place) and (np.diff(place) < 0).any():
                order = np.argsort(place, kind="stable")
                row, column, value, place = row[order], column[order], value[order], place[order]
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            if len(heads):
                yield row[heads], column[heads], np.add.reduceat(value, heads)
            start = stop


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TwoTokenizers:
    """Encoders A (byte-level BPE, JSON) and B (sentence pieces) with the bytes of their tokens.

    A must split texts by the usual byte-level pattern, whose matches never go
    on from a visible character to a space; B's pieces are looked at.

    ``names`` has per tokenizer and id its number as text, with a comma or, for
    the last token of a group, with the mark that follows A's or B's part.
    """

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in known]) for known in (self.a_bytes, self.b_bytes))
        marks = (len(self.a_bytes), ",", "|"), (len(self.b_bytes), ",", ";")
        self.names = [str(i) + mark for n, *both in marks for mark in both for i in range(n)]

        # Where no piece has a space behind a letter, no token of B crosses from a letter to a space.
        self.splits = not any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces)
        self.tokens = [(np.frombuffer(b"".join(known), np.uint8), lengths) for known, lengths in ((self.a_bytes, self.a_lengths), (self.b_bytes, self.b_lengths))]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pools = [Pool(), Pool()]
        self.exact = np.zeros(0, bool)

    def _rendered(self, side: int, ids: np.ndarray, first: np.ndarray, want: np.ndarray, want_first: np.ndarray) -> np.ndarray:
        """Per part whether the bytes of its ids are the wanted ones."""
        data, lengths = self.tokens[side]
        length = lengths[ids]
        upto = np.concatenate([[0], np.cumsum(length)])[first]
        good = np.diff(upto) == np.diff(want_first)
        bytes_ = data[spans((np.cumsum(lengths) - lengths)[ids], length)]
        held = np.flatnonzero(good)
        sizes = np.diff(upto)[held]
        same = bytes_[spans(upto[held], sizes)] == want[spans(want_first[held], sizes)]
        wrong = np.concatenate([[0], np.cumsum(~same)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        good[held] = wrong[ends[1:]] == wrong[ends[:-1]]
        return good

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of both for each part, which is written with one leading space."""
        spaced = [" " + p for p in parts]
        coded = [[e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(parts, num_threads=1)]
        raw = [p.encode() for p in spaced]
        want, want_first = np.frombuffer(b"".join(raw), np.uint8), _firsts(list(map(len, raw)))
        exact = np.ones(len(parts), bool)
        for side, (lists, pool) in enumerate(zip(coded, self.pools, strict=True)):
            ids, first = np.fromiter(chain.from_iterable(lists), np.int64), _firsts(list(map(len, lists)))
            exact &= self._rendered(side, ids, first, want, want_first)
            pool.append(ids.astype(np.int32), np.diff(first))
        self.known.update(zip(parts, range(len(self.exact), len(self.exact) + len(parts)), strict=True))
        self.exact = np.concatenate([self.exact, exact])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tokenizer the ids of all texts and where each text's begin.

        An empty text has none, nor one whose bytes differ from a space and the
        text.  Texts are taken apart at single spaces between visible
        characters: no token of either vocabulary crosses the place before such
        a space, so each part is encoded once, however often it occurs.
        """
        parts = [(SINGLE_SPACE.split(t) if self.splits else [t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        new = set(flat).difference(self.known)
        if new and len(self.known) + len(new) > CACHED:
            self._forget()
            new = set(flat)
        if new:
            self._learn(list(new))
        place = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        text_first = _firsts(list(map(len, parts)))
        wrong = np.concatenate([[0], np.cumsum(~self.exact[place])])[text_first]
        sizes = np.diff(text_first)
        used = place[np.repeat(np.diff(wrong) == 0, sizes)]
        text_first = _firsts(np.where(np.diff(wrong) == 0, sizes, 0))
        out = [pool.taken(used, text_first) for pool in self.pools]
        for p in [p for p in new if len(p) > LONG]:
            del self.known[p]
        return out


class Pool:
    """Id lists one after the other."""

    def __init__(self) -> None:
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.start, self.size = (np.concatenate(x) for x in ((self.ids, ids), (self.start, starts), (self.size, sizes)))

    def taken(self, places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists at ``places`` and, for the groups of places that begin at ``first``, where their ids begin."""
        sizes = self.size[places]
        return self.ids[spans(self.start[places], sizes)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])[first]


def _firsts(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


@dataclass
class Alignment:
    """The tokens of a run of texts, text after text, with the links between them."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_first: np.ndarray  # per text its first token, and the end
    b_first: np.ndarray
    a_group: np.ndarray  # per token
    b_group: np.ndarray
    group_first: np.ndarray  # per text its first group, and the end
    shared: np.ndarray  # per text the pairs of tokens in one group
    links: tuple[np.ndarray, np.ndarray, np.ndarray]  # token of A, token of B, shared bytes


def _groups(ends: np.ndarray, cuts: np.ndarray) -> tuple[CSR, np.ndarray]:
    group = np.searchsorted(cuts, ends)
    return CSR.incidence(np.arange(len(ends) + 1), group, len(cuts)), group


def aligned(coder: TwoTokenizers, texts: list[str]) -> Alignment:
    """Both tokenizations of all texts as two block-diagonal incidence matrices over the bytes of the run."""
    (a_ids, a_first), (b_ids, b_first) = coder.encode(texts)
    a_ends, b_ends = np.cumsum(coder.a_lengths[a_ids]), np.cumsum(coder.b_lengths[b_ids])
    total = int(a_ends[-1]) if len(a_ends) else 0
    tokens_bytes = [CSR.incidence(np.concatenate([[0], ends]), np.arange(total), total) for ends in (a_ends, b_ends)]
    parts = list(tokens_bytes[0].product(tokens_bytes[1].transposed()))
    none = np.zeros(0, np.int64)
    links = tuple(np.concatenate([p[k] for p in parts]) if parts else none for k in range(3))
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    (a_incidence, a_group), (b_incidence, b_group) = _groups(a_ends, cuts), _groups(b_ends, cuts)
    text_ends = np.concatenate([[0], a_ends])[a_first]
    group_first = np.searchsorted(cuts, text_ends, "right")
    met = np.concatenate([[0], np.cumsum(a_incidence.met(b_incidence.transposed()))])
    return Alignment(a_ids, b_ids, a_first, b_first, a_group, b_group, group_first, np.diff(met[a_first]), links)


def group_texts(coder: TwoTokenizers, found: Alignment) -> list[str]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = len(coder.a_bytes), len(coder.b_bytes)
    last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
    n_groups = int(found.group_first[-1])
    a_before = np.concatenate([[0], np.cumsum(np.bincount(found.a_group, minlength=n_groups))])
    b_before = np.concatenate([[0], np.cumsum(np.bincount(found.b_group, minlength=n_groups))])
    codes = np.empty(len(found.a_ids) + len(found.b_ids), np.int64)
    codes[np.arange(len(found.a_ids)) + b_before[found.a_group]] = found.a_ids + n_a * last(found.a_group)
    codes[np.arange(len(found.b_ids)) + a_before[found.b_group + 1]] = 2 * n_a + found.b_ids + n_b * last(found.b_group)
    parts = list(map(coder.names.__getitem__, codes.tolist()))
    bounds = (found.a_first + found.b_first).tolist()
    return ["".join(parts[i:j])[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def runs_of(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` code units of text, one row at least."""
    start, size = 0, 0
    for i, value in enumerate(column):
        more = len(value.as_buffer()) if value.is_valid else 0
        if i > start and size + more > limit:
            yield start, i
            start, size = i, 0
        size += more
    if len(column) > start:
        yield start, len(column)


_CODERS: dict[tuple, TwoTokenizers] = {}


def _shared_files(df: DataFrame, a_path: str, b_path: str):
    """A function for tasks that gives the two tokenizers; their files (1.5 and 0.5 MB) are read here and broadcast."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = df.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def coder() -> TwoTokenizers:
        known = _CODERS.get((a_path, b_path))
        if known is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            known = _CODERS[a_path, b_path] = TwoTokenizers(*files.value)
        return known

    return coder


LINK = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "bytes")])


def align_documents(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``a_ids``, ``b_ids``, ``links`` and ``groups``.

    ``links`` has a token place in ``a_ids``, one in ``b_ids`` and the bytes
    they share, for every overlap; ``groups`` the two ids lists cut where both
    tokenizers end a token.  A text gives empty arrays if it is null, empty or
    not rendered exactly by the tokens of both.  Rows never interact.  Existing
    columns with the new names are replaced.
    """
    names = ["a_ids", "b_ids", "links", "groups"]
    df = df.drop(*names)
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, [ids, ids, T.ArrayType(LINK), T.StringType()], strict=True))])
    coder, at = _shared_files(df, a_path, b_path), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in runs_of(whole.column(at), RUN):
                batch = whole.slice(start, stop - start)
                found = aligned(coder(), [t or "" for t in batch.column(at).to_pylist()])
                text = np.searchsorted(found.a_first, found.links[0], "right") - 1
                places = [found.links[0] - found.a_first[text], found.links[1] - found.b_first[text], found.links[2]]
                links = pa.StructArray.from_arrays([pa.array(p.astype(np.int32)) for p in places], names=["a", "b", "bytes"])
                firsts = [found.a_first, found.b_first, np.searchsorted(found.links[0], found.a_first)]
                values = [pa.array(found.a_ids.astype(np.int32)), pa.array(found.b_ids.astype(np.int32)), links]
                lists = [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), v) for f, v in zip(firsts, values, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(group_texts(coder(), found), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


#: A pair of ids is ``a << SHIFT | b``; vocabularies must be smaller than ``1 << SHIFT``.
SHIFT = 20


def _text_pairs(found: Alignment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair of ids and number of links, for the distinct pairs of each text in order."""
    a, b, _ = found.links
    text = np.searchsorted(found.a_first, a, "right") - 1
    keys, n = np.unique((text << 2 * SHIFT) | (found.a_ids[a] << SHIFT) | found.b_ids[b], return_counts=True)
    return keys >> 2 * SHIFT, keys & ((1 << 2 * SHIFT) - 1), n


def _chunk_rows(chunk: int, held: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The rows of a chunk; the first one carries the chunk's distinct pairs with their numbers of links."""
    sizes = [len(columns[0]) for columns, _ in held]
    starts = np.cumsum([0, *sizes])
    text = np.concatenate([t + at for (_, (t, _, _)), at in zip(held, starts[:-1], strict=True)])
    pair, n = (np.concatenate([found[k] for _, found in held]) for k in (1, 2))
    pairs, codes = np.unique(pair, return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, codes, n)
    first = np.searchsorted(text, np.arange(starts[-1] + 1))
    steps = np.diff(codes, prepend=0)
    heads = first[:-1][np.diff(first) > 0]
    steps[heads] = codes[heads]
    steps, links, packed = steps.astype(np.uint32), n.astype(np.uint32), []
    for i, j in zip(first[:-1], first[1:], strict=True):
        packed.append(pa.compress(np.concatenate([steps[i:j], links[i:j]]), codec="zstd", asbytes=True) if j > i else b"")
    later = [None] * (int(starts[-1]) - 1)
    columns = [pa.chunked_array([c[k] for c, _ in held]).combine_chunks() for k in range(len(held[0][0]))]
    lists = [pa.array([v, *later], pa.list_(pa.int64())) for v in (pairs, counts)]
    own = [pa.array(np.full(starts[-1], chunk)), *columns, pa.array(np.diff(first)), pa.array(packed, pa.binary()), *lists]
    return pa.RecordBatch.from_arrays(own, names=names)


def _chunked(rows: DataFrame, coder, digest: bool) -> DataFrame:
    """Rows ``id, text`` in chunks, each with its numbers and groups and, as ``codes``, its pairs of ids.

    ``codes`` has the places of the text's pairs in the chunk's list, as
    differences, then the links of each pair, compressed.
    """
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), rows.schema["id"],
        *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_shared")),
        T.StructField("groups", T.StringType()), T.StructField("n_pairs", T.LongType()), T.StructField("codes", T.BinaryType()),
        *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("pairs", "counts")),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []
        for whole in batches:
            for start, stop in runs_of(whole.column(1), RUN):
                batch = whole.slice(start, stop - start)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                more = sum(map(len, texts))
                if held and size + more > CHUNK:
                    yield _chunk_rows(chunk, held, schema.names)
                    chunk, size, held = chunk + 1, 0, []
                found = aligned(coder(), texts)
                groups = group_texts(coder(), found)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                n_links = np.diff(np.searchsorted(found.links[0], found.a_first))
                numbers = [np.diff(f) for f in (found.a_first, found.b_first, found.group_first)] + [n_links, found.shared]
                held.append(([batch.column(0), *map(pa.array, numbers), pa.array(groups, pa.string())], _text_pairs(found)))
                size += more
        if held:
            yield _chunk_rows(chunk, held, schema.names)

    return rows.mapInArrow(run, schema)


SCORED = ("n_best", "count_sum")


def _scored(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """A chunk's rows with the sums over their links of what the whole corpus says of each pair."""
    place = right.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
    n_best, count_sum = [], []
    for data, n in zip(left.column("codes").to_pylist(), left.column("n_pairs").to_pylist(), strict=True):
        if not n:
            n_best.append(0)
            count_sum.append(0)
            continue
        values = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64)
        at, links = np.cumsum(values[:n]), values[n:]
        n_best.append(int((best[at] * links).sum()))
        count_sum.append(int((count[at] * links).sum()))
    kept = left.drop_columns(["chunk", "codes", "n_pairs"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).select(names)


def score_alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_shared``, ``groups``, ``n_best``, ``count_sum``.

    ``n_links`` counts the overlapping pairs of tokens and ``n_shared`` the pairs
    in one group.  The count of a pair of ids is its number of links in the
    whole table; ``n_best`` is the number of the row's links whose count is the
    highest of their id of B, ties included, and ``count_sum`` the sum of the
    counts over its links.  ``groups`` is as in ``align_documents``, or with
    ``digest`` its hex SHA-256 ('' without tokens), as the groups of a corpus
    are several times its text.  Null, empty and inexactly rendered texts give
    zeros and no groups.  Rows never meet by id, so null and repeated ids are
    rows of their own, and equal rows count once each.  An empty table gives an
    empty result.

    Texts are aligned once, in chunks.  A chunk hands its distinct pairs to the
    corpus-wide counts and gets back one answer per distinct pair, so a pair
    that is everywhere has one row a chunk, not one a link.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = materialize(_chunked(rows, _shared_files(df, a_path, b_path), digest), "alignments")
    listed = kept.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "of"))
    listed = listed.select("chunk", "place", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n"))
    totals = listed.groupBy("pair").agg(F.sum("n").alias("count"))
    totals = materialize(totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))), "pair-counts")
    highest = totals.groupBy("b").agg(F.max("count").alias("highest"))
    marked = totals.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    answers = listed.join(marked, "pair").select(F.col("chunk").alias("of_chunk"), "place", "count", "best")
    texts = kept.drop("pairs", "counts")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
    names = ["id", *numbers, "groups", *SCORED]
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.StringType() if n == "groups" else T.LongType()) for n in names[1:])])
    found = texts.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(lambda left, right: _scored(left, right, names), schema)
    return found.withColumnRenamed("id", id_col)
