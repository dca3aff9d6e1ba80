"""Vectorised word splitting and hashing over whole Arrow string batches.

Words are maximal runs of bytes other than the ASCII white space
``[\\x20\\x09-\\x0D]``; every separator is one byte, so UTF-8 can be split
without decoding.  All hashes are polynomial (Rabin-Karp) hashes modulo 2**64
computed from prefix sums: a range costs one subtraction and one product,
whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_codes(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=U)
    if lower:
        b[65:91] += U(32)
    return mix64(b + U(0x9E3779B97F4A7C15))


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, b, U))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(0x5851F42D4C957F2D), _Powers(0xD1342543DE82EF95)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _WORD_POWERS) -> np.ndarray:
    """Rabin-Karp hash of ``values[s:e]`` for every pair of ``starts`` and ``ends``."""
    up, down = powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def rolling_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` values, in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    i = np.arange(n)
    return mix64(range_hash(values, i, i + width))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the (leftmost) least value of every window; doubling, not one pass a width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        have += step
    return best[:n]


class Slice:
    """Some texts of a batch: ``bytes``, word bounds and hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool):
        self.first, self.n = first, len(offsets) - 1
        self.data, self.offsets = data, offsets
        n = len(data)
        gap = _SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = edge[:-1].copy()
        before[1:] |= gap[:-1]
        after = edge[1:].copy()
        after[:-1] |= gap[1:]
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        self.word_at = np.searchsorted(self.starts, offsets)
        self.hashes = np.empty(len(self.starts), U)
        at = 0
        while at < len(self.starts):  # whole words, about SLICE_BYTES at a time
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SLICE_BYTES, "right")))
            a, s, e = self.starts[at], self.starts[at:to], self.ends[at:to]
            h = range_hash(_CODES[lower][data[a : e[-1]]], s - a, e - a, _BYTE_POWERS)
            self.hashes[at:to] = mix64(h + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
            at = to

    def text(self, i: int) -> tuple[int, int]:
        """Bounds of the words of the i-th text."""
        return int(self.word_at[i]), int(self.word_at[i + 1])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """The texts of ``column`` in slices of about SLICE_BYTES, whole texts only."""
    if not len(column):
        return
    data, offsets = string_buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        own = offsets[at : to + 1]
        yield Slice(data[own[0] : own[-1]], own - own[0], at, lower)
        at = to
