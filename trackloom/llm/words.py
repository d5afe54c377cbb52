"""Words of whole Arrow columns of text, hashed with numpy.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``. All functions
run inside tasks, on one Arrow batch or one block of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes handled together: bounds the temporary arrays, whatever the batch holds.
CHUNK_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
SEED = 20240611


class Words(NamedTuple):
    """Words of some consecutive documents: bounds in ``data``, two hashes, and the
    first word of each document (one entry more than there are documents)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the bounds of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i < n."""
    row = np.full(max(n, 1), base, np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


class Rolling:
    """Hashes of any range of a sequence from prefix sums modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values) + 1:
            self.up = powers(self.base, len(values) + 1)
            self.down = powers(self.inverse, len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


class WordHasher:
    """Cuts texts into words and hashes each word twice with 64 bits."""

    def __init__(self, lower: bool = False):
        generator = np.random.default_rng(SEED)
        self.tables = generator.integers(1, 1 << 63, (2, 256), np.uint64)
        if lower:
            self.tables[:, 65:91] = self.tables[:, 97:123]
        self.rolling = (Rolling(0x9E3779B97F4A7C15), Rolling(0xD1B54A32D192ED03))
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def words(self, data: np.ndarray, bounds: np.ndarray) -> Words:
        blank = self.space[data]
        border = np.zeros(len(data) + 1, bool)
        border[bounds] = True
        after = np.ones(len(data) + 1, bool)
        after[1:] = blank
        after |= border
        before = np.ones(len(data) + 1, bool)
        before[:-1] = blank
        starts = np.flatnonzero(after[:-1] & ~blank)
        ends = np.flatnonzero((before | border)[1:] & ~blank) + 1
        hashes = []
        for table, rolling in zip(self.tables, self.rolling):
            hashes.append(rolling.ranges(rolling.prefix(table[data]), starts, ends))
        return Words(data, starts, ends, *hashes, np.searchsorted(starts, bounds))

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, int, Words]]:
        """(first row, end row, their words), some rows at a time."""
        data, bounds = text_bytes(column)
        row, rows = 0, len(bounds) - 1
        while row < rows:
            end = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1
            end = min(max(end, row + 1), rows)
            low, high = bounds[row], bounds[end]
            yield row, end, self.words(data[low:high], bounds[row:end + 1] - low)
            row = end
