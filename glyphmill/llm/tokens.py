"""Words and word hashes of whole Arrow batches at once, with numpy.

A word is a run of bytes other than space and \\x09-\\x0D. Hashes are polynomials modulo 2**64 over random
byte values, mixed afterwards; all of a slice is hashed by one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything of ASCII but letters and digits; bytes beyond ASCII count as letters.
NOT_LETTERS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = np.random.default_rng(7919).integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) <= n:
        size = (n + (1 << 17)) >> 16 << 16
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        one = np.ones(size, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = base, inverse
        have = _tables[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever place it stands at."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """raw: bytes of the slice; offsets: where each text starts in raw; starts, ends: of words; first: index of each text's first word."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, fold: bool = False, first_bytes: int = 0) -> np.ndarray:
        """Of whole words, or of their first bytes; fold: with A-Z lower-cased."""
        raw = _FOLD[self.raw] if fold else self.raw
        ends = np.minimum(self.ends, self.starts + first_bytes) if first_bytes else self.ends
        return span_hashes(_VALUE[raw], self.starts, ends, BASES[0])


def raw_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `most` bytes; a longer text has a run of its own. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(texts: pa.Array, most: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, Words]]:
    """gaps: for each byte, whether it separates words."""
    for row, raw, offsets in raw_slices(texts, most):
        gap = gaps[raw]
        inside = ~gap
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.ones(len(raw), bool)
        before[1:] = gap[:-1]
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.ones(len(raw), bool)
        after[:-1] = gap[1:]
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        yield row, Words(raw, offsets, starts, ends, np.searchsorted(starts, offsets))
