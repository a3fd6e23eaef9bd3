"""Byte-level BPE as a monoid: halves are encoded, then joined at the seam.

A token sequence is the BPE encoding of its bytes exactly if every two
neighbours, taken alone, encode to themselves: the first merge to cross a token
boundary would also be made when only the two tokens at that boundary are
encoded, as merges inside tokens do not depend on what lies outside.  Joining
two encodings therefore re-encodes a window at the seam, widened until the
pairs at both of its ends pass that test; everything outside is then final.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF = 16
CACHED = 600_000
NEVER = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def concatenated(parts: list[bytes]) -> bytes:
    """Concatenation as the decoder's monoid: leaves of ``LEAF`` tokens, then neighbours pairwise up to the root."""
    parts = [b"".join(parts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


class TreeBPE:
    """Encoder and decoder for one set of ranks; all 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until no pair is a token."""
        return self._merged_by_scan(data) if len(data) <= 2 * LEAF else self._merged_by_queue(data)

    def _merged_by_scan(self, data: bytes) -> list[int]:
        """For a few bytes: look at all pairs for each merge."""
        rank = self.ranks.get
        part = [data[i : i + 1] for i in range(len(data))]
        pair = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pair:
            lowest = min(pair)
            if lowest == NEVER:
                break
            i = pair.index(lowest)
            part[i] += part.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = rank(part[i] + part[i + 1], NEVER)
            if i:
                pair[i - 1] = rank(part[i - 1] + part[i], NEVER)
        return [self.ranks[p] for p in part]

    def _merged_by_queue(self, data: bytes) -> list[int]:
        """For many bytes: a heap of candidate pairs over a linked list of parts."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (r := ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (r, i, part[i], part[j]))

        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or part[i] is not left or part[j] is not right:
                continue  # one of the two was merged meanwhile
            part[i] = left + right
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[p] for p, live in zip(part, alive, strict=True) if live]

    def settled(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left or right
        if self.settled(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.settled(left[i - 1], window[0])) and (
                j == len(right) or self.settled(window[-1], right[j])
            ):
                return left[:i] + window + right[j:]
            reach *= 2

    def reduced(self, data: bytes) -> list[int]:
        """Encode the halves, recursively, and join them."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.reduced(data[:half]), self.reduced(data[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """One match of the pattern; a piece that is a token as a whole is that token."""
        known = self.pieces.get(text)
        if known is None:
            data = text.encode()
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else tuple(self.reduced(data))
            if len(data) <= 64:
                if len(self.pieces) >= CACHED:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        """All matches of the pattern in turn; none joins across a match's end."""
        ids: list[int] = []
        get, extend = self.pieces.get, ids.extend
        for match in self.find(text):
            extend(get(match) or self.piece(match))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of all tokens, concatenated up the tree."""
        return concatenated(list(map(self.bytes_of.__getitem__, ids)))


_ENCODERS: dict[str, TreeBPE] = {}


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """All rows and columns of ``df`` with ``token_ids`` (array of int) and, on request, ``decoded`` (binary).

    The ranks file is read on the driver and broadcast (its size is that of one
    vocabulary, about 1 MB).  A null text counts as empty and gives no ids.
    Texts are encoded whole; rows never interact, so ties, repeated rows and
    empty tables need no rule.  Existing columns named ``token_ids`` or
    ``decoded`` are replaced.
    """
    with open(ranks_path, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))]
    if decode:
        added.append(T.StructField("decoded", T.BinaryType()))
    df = df.drop("token_ids", "decoded")
    schema = T.StructType([*df.schema.fields, *added])
    at, names = df.columns.index(text_col), schema.names

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.get(ranks_path)
        if coder is None:
            coder = _ENCODERS[ranks_path] = TreeBPE(read_ranks(raw.value), pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids = [coder.encode(text) if text else [] for text in batch.column(at).to_pylist()]
                columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    columns.append(pa.array(map(coder.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(encode, schema)


def decode_documents(df: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """All rows and columns of ``df`` with ``decoded``, the bytes of ``ids_col``; null ids decode to no bytes."""
    with open(ranks_path, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])
    at, names = df.columns.index(ids_col), schema.names

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {rank: token for token, rank in read_ranks(raw.value).items()}
        for batch in batches:
            found = [concatenated([table[i] for i in ids or ()]) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=names)

    return df.mapInArrow(decode, schema)
