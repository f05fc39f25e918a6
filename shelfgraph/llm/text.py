"""Numpy views of Arrow text columns: bytes of many documents at once, their words, and 64-bit keys of byte ranges.

A word is a maximal run of bytes other than blank and \\t \\n \\v \\f \\r; on UTF-8 this is ``[^\\x20\\x09-\\x0D]+``.
Keys are polynomial hashes (mod 2**64, odd base) of random byte values, finished with a bit mixer. Equal bytes give
equal keys; different bytes give equal keys with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 4 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=_U)
    return _powers[0], _powers[1]


class Chunk(NamedTuple):
    """Rows ``first .. first + n - 1`` of a batch: all their bytes, and where each row's begin and end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray  # n + 1 values, from 0

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a text column in pieces of about ``limit`` bytes; a longer row is a piece of its own. Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, len(column), i + 20_000)
        yield Chunk(i, raw[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j


class RangeKeys:
    """Keys of any byte ranges of one array, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray      # the row of the chunk that each word belongs to
    first: np.ndarray    # n + 1 values: the words of row r are first[r] .. first[r + 1] - 1


def words(chunk: Chunk, outside: np.ndarray = BLANK) -> Words:
    """The words of each row: runs of bytes that are not ``outside``; none reaches over the end of its row."""
    data, offsets = chunk.data, chunk.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(chunk.n + 1, np.int64))
    solid = ~outside[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(chunk.n), np.diff(first)), first)


def window_keys(keys: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all windows of ``k`` words inside one row: (key, index of its first word, row)."""
    n = len(keys)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n) >= k
    at = np.flatnonzero(room)
    out = np.full(len(at), k, _U)
    for j in range(k):
        out = mix(out * _U(0x9FB21C651E98DF25) + keys[at + j])
    return out, at, np.searchsorted(first, at, "right") - 1


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of all rows begin, and where they end (after their line break, if they have one)."""
    first = np.zeros(len(chunk.data) + 1, bool)
    first[chunk.offsets[:-1]] = True
    first[1:] |= chunk.data == 10
    start = np.flatnonzero(first[:-1])
    return start, np.append(start[1:], len(chunk.data)) if len(start) else start
