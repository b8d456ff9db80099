"""Vectorised words of Arrow text batches, for use inside tasks.

Texts of a batch lie back to back in one byte buffer, so words are found and hashed
for many rows at once. Work is done in slices of a few MB, and a single long text is
cut at word ends, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1

#: ASCII blanks 09-0D and 20 separate words; every other byte belongs to one.
BLANKS = bytes([*range(9, 14), 32])


def word_bytes(separators: bytes) -> np.ndarray:
    """Table of 256 flags: which bytes belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


NOT_BLANK = word_bytes(BLANKS)


def lowered() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    v = values.copy()
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def row_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SLICE_BYTES`` each, or one row."""
    lo, n, limit = 0, len(offsets) - 1, SLICE_BYTES
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Finds and hashes words; tables are made once per task."""

    def __init__(self, table: np.ndarray = NOT_BLANK, lower: bool = True) -> None:
        self.table = table
        self.values = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + np.uint64(1)
        if lower:
            self.values = self.values[lowered()]
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            up = np.full(n + 1, _BASE, dtype=np.uint64)
            down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and per row the number of its first word (one more than rows)."""
        inside = self.table[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins, stops = offsets[:-1], offsets[1:]
        some = stops > begins
        first[begins[some]] = inside[begins[some]]
        last[stops[some] - 1] = inside[stops[some] - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)

    def pieces(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of a long text of about ``SLICE_BYTES`` that end between words."""
        at = 0
        while at < len(data):
            stop = min(len(data), at + SLICE_BYTES)
            while stop < len(data) and self.table[data[stop]]:
                gap = np.flatnonzero(~self.table[data[stop : stop + 4096]])
                stop = min(len(data), stop + (int(gap[0]) if len(gap) else 4096))
            yield at, stop
            at = stop

    def hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])

    def hashed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all words of the rows, and per row the number of its first word."""
        if len(data) <= 2 * SLICE_BYTES:
            starts, ends, first = self.spans(data, offsets)
            return self.hash(data, starts, ends), first
        found = []  # one long text
        for lo, hi in self.pieces(data):
            starts, ends, _ = self.spans(data[lo:hi], np.array([0, hi - lo]))
            found.append(self.hash(data[lo:hi], starts, ends))
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, hashes, first word per row) for slices of a text column."""
        data, offsets = text_buffer(column)
        for lo, hi in row_slices(offsets):
            part = offsets[lo : hi + 1]
            hashes, first = self.hashed(data[part[0] : part[-1]], part - part[0])
            yield lo, hi, hashes, first


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row, rows without words included."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
