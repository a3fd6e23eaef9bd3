"""Words of Arrow text columns as 64-bit hashes, computed for a whole batch at once.

Words are maximal runs of bytes other than the six ASCII white-space bytes;
these never occur inside a UTF-8 character, so byte-wise splitting is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Odd multipliers of the mixing steps (fixed values).
M1, M2, M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

#: Bytes of text that are hashed at once; a longer single text is a chunk of its own.
CHUNK = 2_000_000


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64((0xD1342543DE82EF95 * (2 * salt + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``first[d] : first[d + 1]`` are the words of text ``d``; ``hashes`` has one value per word."""

    first: np.ndarray
    hashes: np.ndarray


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0)), dtype=np.int64)
    start, n = 0, len(column)
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        yield start, stop
        start = stop


def hashed_words(column: pa.Array, lower: bool = False) -> Words:
    """Word hashes of a string column without nulls."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    n = len(column)
    if n == 0:
        return Words(np.zeros(1, np.int64), np.zeros(0, np.uint64))
    offsets = np.frombuffer(offset_buffer, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if lower:
        data = LOWER[data]
    inside = np.empty(size + 1, bool)
    inside[:size] = IN_WORD[data[:size]]
    inside[size] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    texts = offsets[:-1][offsets[:-1] < size]
    begins[texts] = inside[texts]  # a word may begin where the text before ends in one
    begins[size] = False
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:size] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(stops[:size]) + 1
    length = ends - starts
    lanes = np.ndarray((size + 1,), "<u8", data.data, strides=(1,))
    h = length.astype(np.uint64) * M1
    step = 0
    active = np.arange(len(starts))
    while len(active):
        left = length[active] - step
        value = lanes[starts[active] + step] & KEEP[np.minimum(left, 8)]
        part = (h[active] ^ value) * M2
        h[active] = part ^ (part >> np.uint64(29))
        step += 8
        active = active[left > 8]
    return Words(np.searchsorted(starts, offsets), mixed(h))


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of the ``k`` values from each position on (where ``k`` are left)."""
    base = np.uint64((0xA0761D6478BD642F + 2 * salt * 0xE7037ED1A0B428DB) % 2**64 | 1)
    n = max(0, len(hashes) - k + 1)
    whole, covered = None, 0
    block, width, power = hashes, 1, base
    left = k
    while left:
        if left & 1:
            if whole is None:
                whole = block
            else:  # append a block of ``width`` behind the ``covered`` values
                m = len(hashes) - covered - width + 1
                whole = whole[: max(0, m)] * power + block[covered : covered + max(0, m)]
            covered += width
        left >>= 1
        if left:
            m = max(0, len(block) - width)
            block = block[:m] * power + block[width : width + m]
            width, power = 2 * width, np.uint64(int(power) * int(power) % 2**64)
    return mixed(whole[:n], salt + 7)
