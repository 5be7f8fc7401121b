"""Words and their hashes for whole columns of texts, as numpy arrays over the UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomial hashes and of the final mixing step.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)
#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> _SHIFT)
    h = h * _MIX[0]
    h ^= h >> _SHIFT
    h *= _MIX[1]
    h ^= h >> _SHIFT
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 14))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:  # tables for a giant text are not kept
            _powers[base] = have
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every span, whatever its place."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """The words of a slice of texts: ``starts`` and ``ends`` in ``data``, and per text its words' range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin, end = ~gap, ~gap
        begin[1:] &= gap[:-1]
        begin[first] = ~gap[first]
        end[:-1] &= gap[1:]
        end[last] = ~gap[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.texts = np.searchsorted(self.starts, offsets)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per word; ``lower`` lower-cases A-Z first."""
        data = self.data
        if lower:
            data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
        raw = span_hash(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BASES[which])
        return mix(raw ^ (self.ends - self.starts).astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Ranges of rows holding about ``size`` bytes, with their words."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
