"""Words and word hashes of whole text batches as numpy arrays.

A batch of an Arrow string column is one byte buffer with offsets. Separators of words are single ASCII bytes, so words
are found on the bytes of the whole batch at once; no text is decoded and no Python object is made for a word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from evidloom.shipping import ship_by_value

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _POWERS[key] = have
    return have[:n]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table of the bytes that separate words, from inclusive byte ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a batch: byte range, document index and 64-bit hash of each, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        n = len(offsets) - 1
        low = LOWER[data]
        apart = separator[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~apart
        first = inside.copy()
        if len(data):
            first[1:] &= apart[:-1] | edge[1:-1]
            last = inside.copy()
            last[:-1] &= apart[1:] | edge[1:-1]
        else:
            last = first
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[low] * _powers(len(data), _MUL), out=total[1:])
            value = total[self.end] - total[self.start]
            self.hash = mix(value * _powers(len(data) + 1, _INV)[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document index and first word of each window of ``size`` words.

        A document of fewer words, but not none, is one window.
        """
        count = self.count
        spans = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
        doc = np.repeat(np.arange(len(count)), spans)
        begin = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(self.first[:-1], spans)
        ends = np.append(self.first[1:], 0)[doc] if len(doc) else begin
        value = np.zeros(len(doc), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                at = begin + k
                there = at < ends
                word = self.hash[np.where(there, at, 0)] if len(self.hash) else value
                value = mix(value * _MUL + np.where(there, word, np.uint64(0)) + np.uint64(k + 1) * there.astype(np.uint64))
        return value, doc, begin


ship_by_value(__name__)
