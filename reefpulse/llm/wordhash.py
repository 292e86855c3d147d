"""Words of many texts at once: numpy over the UTF-8 buffer of an Arrow column.

A word is a run of bytes other than space and tab to carriage return, which is
what ``bytes.split()`` gives. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHUNK_BYTES = 1 << 18
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64 for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(CHUNK_BYTES + 1, n + 1)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (base, inverse)
        )
        if size == CHUNK_BYTES + 1:
            _powers[base] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """A hash of ``values[s:e]`` for each pair: polynomial prefix sums modulo 2 ** 64."""
    up, down = _power_table(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a few texts. ``offsets[d]:offsets[d + 1]`` are the words of text ``d``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.bytes = _LOWER[raw] if lower else raw
        self.byte_offsets = at - at[0]
        inside = ~_SPACE[self.bytes]
        filled = self.byte_offsets[:-1][np.diff(self.byte_offsets) > 0]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[filled] = False
            after[filled[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, self.byte_offsets)
        self.counts = np.diff(self.offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(_BYTE_VALUE[self.bytes], self.starts, self.ends, _BYTE_BASE)
        return self._hashes

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each start to each end."""
        return span_hashes(_BYTE_VALUE[self.bytes], starts, ends, _BYTE_BASE)

    def gram_starts(self, n: int) -> np.ndarray:
        """Indexes of words at which ``n`` consecutive words of one text begin."""
        left = np.repeat(self.offsets[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The text to which each word index belongs."""
        return np.searchsorted(self.offsets, words, side="right") - 1


def sliding_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each run of ``width`` values, and the last index that holds it."""
    best, where, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        right = b <= a
        best, where = np.where(right, b, a), np.where(right, where[step:], where[:-step])
        have += step
    return best, where


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    if not len(column):
        return
    size = np.asarray(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        base = total[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield lo, hi
        lo = hi
