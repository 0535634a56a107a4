"""Words, lines and n-grams of whole Arrow batches, as numpy arrays.

All texts of a batch lie in one byte buffer. A span never crosses the border of two texts. Hashes are multilinear over 64 bits
with weights drawn from splitmix64, so equal spans have equal hashes on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PART_BYTES = 4 << 20
_CHUNK = 1 << 20  # bytes hashed at a time, which bounds the temporary arrays

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_LETTERS = ~_LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTES = mixed(np.arange(256) + 1)


@dataclass
class Spans:
    """start and end: bytes in data; text: number of the row that holds the span."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def cuts(column: pa.Array, size: int = PART_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes together; a longer text is alone."""
    ends = buffer_of(column)[1][1:]
    out, lo = [], 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + size, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task and would keep what its largest batch needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def bounded(batches: Iterable[pa.RecordBatch], column: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones by the bytes of a text column, which bounds the arrays made from them."""
    for batch in batches:
        for lo, hi in cuts(batch.column(column), size):
            yield batch.slice(lo, hi - lo)
        release()


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> Spans:
    """Longest runs of bytes that are no breaks."""
    part = ~breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], part))
    after = np.concatenate((part, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Spans(data, start, end, np.searchsorted(offsets, start, "right") - 1, len(offsets) - 1)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines between newlines, empty ones too. Every text has one at least."""
    newline = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], newline)), kind="stable")
    text = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(newline, offsets)))
    return Spans(data, start, end, text, len(offsets) - 1)


def hashes(s: Spans, mapped: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes, after mapping them."""
    table = _BYTES if mapped is None else _BYTES[mapped]
    size = s.end - s.start
    out = np.zeros(len(size), np.uint64)
    if not len(size):
        return out
    weights = mixed(np.arange(int(size.max()) + 1) + 1000) | np.uint64(1)
    until = np.cumsum(size)
    lo = 0
    while lo < len(size):
        done = until[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(until, done + _CHUNK, "right")))
        some = np.flatnonzero(size[lo:hi]) + lo
        if len(some):
            n = size[some]
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            value = table[s.data[place + np.repeat(s.start[some], n)]] * weights[place]
            out[some] = np.add.reduceat(value, first)
        lo = hi
    return mixed(out + size.astype(np.uint64))


def grams(h: np.ndarray, text: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n items within one text, and the place of its first item."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    weights = mixed(np.arange(n) + 77_777 + 1_000 * seed) | np.uint64(1)
    last = len(h) - n + 1
    out = np.zeros(last, np.uint64)
    for j in range(n):
        out += h[j:j + last] * weights[j]
    at = np.flatnonzero(text[:last] == text[n - 1:n - 1 + last])
    return mixed(out[at]), at


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size items lie in a run of n items that begins at one of the places."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + n, size), -1)
    return np.cumsum(step[:-1]) > 0
