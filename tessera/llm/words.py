"""Words `[^\\x20\\x09-\\x0D]+` of Arrow text columns as 64-bit fingerprints, without a Python loop over words.

A fingerprint is a polynomial over the bytes (or over the word fingerprints of a window), taken from
prefix sums modulo 2**64 and mixed afterwards; powers of an odd base have inverses, so any range costs
one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
INK = (~SPACE).tobytes()
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BYTE_BASE_2, WORD_BASE_2 = 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F
CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK + 64)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            pair.append(np.cumprod(x, dtype=np.uint64))
        have = _powers[base] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial of values[start:end] for each range."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    first: int  #: index of the first text of this chunk
    bounds: np.ndarray  #: words of text first + i are bounds[i]:bounds[i + 1]
    h: np.ndarray  #: fingerprint of each word
    starts: np.ndarray  #: byte range of each word in data
    ends: np.ndarray
    data: np.ndarray  #: the bytes of the chunk, folded

    def windows(self, k: int, base: int = WORD_BASE, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start word and fingerprint of every k consecutive words of one text, in order."""
        h = self.h if h is None else h
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends_at = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(len(h)) + k <= ends_at)
        return at, ranges(h, at, at + k, base)

    def second(self) -> np.ndarray:
        """Fingerprints from another base, to tell words whose first ones agree."""
        return ranges(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, BYTE_BASE_2)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column: pa.Array, fold: np.ndarray = AS_IS) -> Iterator[Words]:
    """The texts of a column in chunks of about a megabyte; a longer text makes a chunk of its own."""
    offsets, data = text_buffers(column)
    n, i, table = len(offsets) - 1, 0, fold.tobytes()
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        folded, cuts = data[offsets[i] : offsets[j]].tobytes().translate(table), offsets[i : j + 1] - offsets[i]
        part, ink = np.frombuffer(folded, np.uint8), np.frombuffer(folded.translate(INK), bool)
        edge = np.zeros(len(part) + 1, bool)
        edge[cuts] = True
        # between two bytes a word begins or ends where one of them is no ink, or a text does
        edge[1:-1] |= ~(ink[:-1] & ink[1:])
        edge[[0, -1]] = True
        starts, ends = np.flatnonzero(ink & edge[:-1]), np.flatnonzero(ink & edge[1:]) + 1
        h = ranges(part.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)
        yield Words(i, np.searchsorted(starts, cuts).astype(np.int64), h, starts, ends, part)
        i = j
