"""Vectorised reading of texts inside a task: words, hashes and shingles as numpy arrays.

A whole batch is one byte array; words are runs of other bytes than separators and never cross a
text's end. A word is read in lanes of 8 bytes, the last one filled up with zeros. Its 64-bit hash sums a
strong mix of each lane's value and number, and mixes the sum with the length: no lane cancels another.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACES = bytes([32, 9, 10, 11, 12, 13])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(lower: bool) -> np.ndarray:
    """What each byte is read as; with ``lower``, A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] = table[97:123]
    return table


def separators(extra: bytes = b"") -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(_SPACES + extra)] = True
    return out


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[
            column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, size[start] + most, "right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = stop


#: The modules under whose names operators keep something for a worker's later tasks, and the attribute that holds it.
KEPT = ("tokenizers", "_driftline_pieces")


def give_back() -> None:
    """Returns memory that is free in this process to the system, and what another operator's tasks kept in this worker."""
    getattr(sys.modules.get(KEPT[0]), "__dict__", {}).pop(KEPT[1], None)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after the other, and where each begins; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def padded(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """The bytes as they are read, and 8 zeros."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[:len(data)] = byte_table(True)[data] if lower else data
    return out


def lanes(read: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 8-byte lanes of the runs of ``read`` (padded), each lane's number in its run, and where each run's lanes begin."""
    size = end - start
    count = np.maximum(-(-size // 8), 1)
    number = spread(np.zeros(len(count), np.int64), count)
    from_8 = np.ndarray((len(read) - 7,), "<u8", read, strides=(1,))
    value = from_8[np.repeat(start, count) + 8 * number]
    value &= _FIRST_BYTES[np.clip(np.repeat(size, count) - 8 * number, 0, 8)]
    return value, number, np.cumsum(count) - count


def lane_hash(value: np.ndarray, number: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run from its lanes and its length."""
    if not len(first):
        return np.zeros(0, np.uint64)
    value = mix(mix(value + _ODD) ^ mix(number.astype(np.uint64) * _ODD))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _ODD)


class Words:
    """``start``/``end`` byte places, ``hash`` and ``bounds`` (first word of each text) of a batch's words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True, separator: np.ndarray | None = None):
        gap = (separators() if separator is None else separator)[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = True, gap[:-1]
            self.start = np.flatnonzero(~gap & (before | first[:-1]))
            after = np.empty(len(data), bool)
            after[-1], after[:-1] = True, gap[1:]
            self.end = np.flatnonzero(~gap & (after | first[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.data, self.at = data, at
        self.bounds = np.searchsorted(self.start, at)
        self._read = padded(data, lower)
        self.hash = self.hashes(self.end)

    def hashes(self, end: np.ndarray) -> np.ndarray:
        """Hash of each word up to ``end``."""
        return lane_hash(*lanes(self._read, self.start, end), end - self.start)

    def insert(self, word: np.ndarray, cut: np.ndarray) -> None:
        """Cut each ``word`` in two at the byte ``cut``."""
        added = np.zeros(len(self.start) + 1, np.int64)
        added[word + 1] = 1
        self.bounds = self.bounds + np.cumsum(added)[self.bounds]
        self.end = np.insert(self.end, word, cut)
        self.start = np.insert(self.start, word + 1, cut)
        self.hash = self.hashes(self.end)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.bounds))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles and where each text's begin; repeats are kept.

    A text with fewer words is one shingle of all of them; one without words has none.
    """
    h, n = words.hash, np.diff(words.bounds)
    full = np.maximum(n - size + 1, 0)
    count = np.where(n > 0, np.maximum(full, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.uint64)
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mix(h[k:len(h) - size + 1 + k] + np.uint64(k))
        place = np.arange(full.sum()) + np.repeat(words.bounds[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full)
        out[np.repeat(full > 0, count)] = mix(rolled[place])
    for i in np.flatnonzero((n > 0) & (n < size)):
        value = np.uint64(0)
        for k, x in enumerate(h[words.bounds[i]:words.bounds[i + 1]]):
            with np.errstate(over="ignore"):
                value = value * np.uint64(0xD6E8FEB86659FD93) + mix(np.array([x + np.uint64(k)]))[0]
        out[at[i]] = mix(np.array([value ^ np.uint64(int(n[i]) * 0x9E3779B97F4A7C15 % 2**64)]))[0]
    return out, at


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` for ``count[i]`` numbers each, one after the other."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)
