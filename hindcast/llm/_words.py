"""Words of a column of texts, and 64-bit hashes of words and of runs of words, as numpy arrays over Arrow's own buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; no word crosses from one text to the next. A word's hash is
the sum of random 64-bit values, one for each byte and place in a part of 32 bytes, passed through a finishing mix; longer
words add up the mixed hashes of their parts, each mixed with its number. A run's hash joins two halves' by a product, a sum
and a mix. So no two words or runs meet by the arithmetic of their bytes; `lane` picks one of several independent hashes.
Memory: about 30 bytes a byte of the batch's block, blocks being about a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Bytes hashed at once, so that what is in hand stays in the processor's caches.
HASHED = 1 << 17
PART = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = (0xD1342543DE82EF95, 0xDA942042E4DD58B5)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of letters, digits and non-ASCII characters, after A-Z are lowered.
PLAIN = np.ones(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_tables: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _values(lane: int) -> np.ndarray:
    """A random value of each byte at each place of a part."""
    if lane not in _tables:
        _tables[lane] = mix(mix(np.arange(1, PART * 256 + 1, dtype=np.uint64) * _ODD + np.uint64(lane * 7919)) ^ np.uint64(0x6A09E667F3BCC909))
    return _tables[lane]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each text begins and ends in them; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(at: np.ndarray, limit: int = 8 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = high


def portions(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work that holds many objects for each."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


class Words:
    """start, end: of each word in data; first: of each text, its first word's number, and one past the last."""

    def __init__(self, data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE):
        self.data = data
        inside = ~space[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            fresh = np.zeros(len(data) + 1, bool)
            fresh[at] = True
            begins[1:] &= ~inside[:-1] | fresh[1:-1]
            ends[:-1] &= ~inside[1:] | fresh[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The number of the text that holds each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lane: int = 0, prefix: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first `prefix` bytes."""
        out, n = np.empty(len(self), np.uint64), len(self)
        ends = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        size, values, low = ends - self.start, _values(lane), 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.start, self.start[low] + HASHED)))
            begin, finish = self.start[low], ends[high - 1]
            s, e = self.start[low:high] - begin, ends[low:high] - begin
            # Bytes between words and behind a prefix get values too, and are in no word's sum.
            place = np.arange(finish - begin, dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(s, append=finish - begin))
            total = np.zeros(finish - begin + 1, np.uint64)
            np.cumsum(values[(place % PART << 8) + self.data[begin:finish]], out=total[1:])
            out[low:high] = mix((total[e] - total[s]) ^ size[low:high].astype(np.uint64) * _ODD)
            low = high
        long = np.flatnonzero(size > PART)
        for low in range(0, len(long), 256):
            which = long[low : low + 256]
            out[which] = self._long_hashes(self.start[which], size[which], lane)
        return out

    def _long_hashes(self, start: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
        to = np.cumsum(size)
        place = np.arange(to[-1]) - np.repeat(to - size, size)
        known = _values(lane)[(place % PART << 8) + self.data[place + np.repeat(start, size)]]
        parts = np.flatnonzero(place % PART == 0)
        number = (place[parts] // PART).astype(np.uint64)
        hashed = mix(np.add.reduceat(known, parts) + mix(number * _ODD + np.uint64(lane + 1)))
        return mix(np.add.reduceat(hashed, np.searchsorted(parts, to - size)) ^ size.astype(np.uint64) * _ODD)

    def inside(self, k: int) -> np.ndarray:
        """For each run of k consecutive words, whether it lies within one text."""
        ok = np.ones(max(0, len(self) - k + 1), bool)
        over = (self.first[1:, None] - np.arange(1, k)).ravel()
        ok[over[(over >= 0) & (over < len(ok))]] = False
        return ok

    def strings(self, which: np.ndarray) -> pa.Array:
        """The chosen words' bytes."""
        s, length = self.start[which], (self.end - self.start)[which]
        at = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        source = np.arange(at[-1]) + np.repeat(s - at[:-1], length)
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(self.data[source])])


def runs(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, built by doubling; wraps over text ends, see Words.inside."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, size, power, out, done = np.uint64(_STEP[lane]), 1, h, None, 0
    while True:
        if k & size:
            part = power[done : done + n] if out is not None else power[:n]
            out = part.copy() if out is None else mix(out * factor + part)
            done += size
        if size * 2 > k:
            break
        power = mix(power[:-size] * factor + power[size:])
        size *= 2
    return mix(out ^ np.uint64(k))


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
