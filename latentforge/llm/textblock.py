"""Numpy views of text columns inside tasks.

Arrow record batches are cut into blocks of whole documents of about
``BLOCK_BYTES`` (one longer document is a block of its own), so that the
arrays a task holds are bounded by one block whatever the batch size. A
block gives the bytes of its documents end to end, word boundaries, and
64-bit fingerprints of any byte range by polynomial prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

U = np.uint64
#: odd multipliers (fixed values of a published 64-bit finaliser, and a base)
MIX_1 = U(0xBF58476D1CE4E5B9)
MIX_2 = U(0x94D049BB133111EB)
GOLDEN = U(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def times_golden(n: int) -> np.uint64:
    """``n * GOLDEN`` modulo 2^64."""
    return U(n * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(salt << 32)) * GOLDEN)


BYTE_CODE = seeds(256, 77)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK_BYTES)
            ones = np.ones(size, U)
            up, down = ones.copy(), ones
            up[1:], down[1:] = U(BASE), U(BASE_INV)
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up[:n], self.down[:n]


@cache
def _powers() -> _Powers:
    return _Powers()


class Prefix:
    """Fingerprints of ranges of a byte array (optionally A-Z lower-cased)."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        code = BYTE_CODE[ASCII_LOWER] if lower else BYTE_CODE
        up, self.down = _powers().get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(code[data] * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(U) * GOLDEN)

    def windows(self, n: int) -> np.ndarray:
        """Fingerprints of all windows of ``n`` bytes."""
        k = len(self.sums) - n
        if k <= 0:
            return np.zeros(0, U)
        return mix((self.sums[n:] - self.sums[:k]) * self.down[:k] + times_golden(n))


class Block:
    """Documents ``row0 .. row0 + n`` of a batch, as one byte array."""

    def __init__(self, row0: int, data: np.ndarray, offsets: np.ndarray):
        self.row0, self.data, self.offsets, self.n = row0, data, offsets, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, first)``: byte ranges of the words; the words of
        document i are ``first[i]:first[i + 1]``."""
        n = len(self.data)
        inside = ~IS_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(s, self.offsets)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if big else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents that cover the column."""
    data, off = column_bytes(column)
    row, n = 0, len(off) - 1
    while row < n:
        upto = int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1
        upto = min(max(upto, row + 1), row + 65536, n)
        yield Block(row, data[off[row]:off[upto]], off[row:upto + 1] - off[row])
        row = upto


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i has the next ``counts[i]`` of ``values``."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
