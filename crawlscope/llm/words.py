"""Byte-level word hashing shared by the text operators.

Works straight on Arrow string buffers (UTF-8 bytes plus offsets): words are
maximal runs of bytes admitted by a 256-entry table, and each word gets a
64-bit polynomial hash read off one prefix sum.  No Python object is made per
word.  Everything is done in slices of about ``CHUNK_BYTES``; one very long
text forms a slice of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

CHUNK_BYTES = 1 << 20

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_POINT_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every bit of ``x`` over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def class_table(kind: str) -> np.ndarray:
    """Which bytes belong to a word.  ``alnum``: 0-9, letters and every
    non-ASCII byte.  ``graph``: all bytes but space and tab..carriage return.
    ``symbol``: ``graph`` without ``alnum``."""
    table = np.zeros(256, dtype=bool)
    if kind == "alnum":
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
        table[0x80:] = True
    elif kind == "graph":
        table[:] = True
        table[0x20] = table[0x09:0x0E] = False
    elif kind == "symbol":
        table = class_table("graph") & ~class_table("alnum")
    else:
        raise ValueError(kind)
    return table


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and leaves all else alone."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base = int(base)
        self.inverse = np.uint64(pow(self.base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            n = max(n, CHUNK_BYTES + 4096)
            self.up = _powers(np.uint64(self.base), n)
            self.down = _powers(self.inverse, n)
        return self.up, self.down


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks run
    by the same worker share powers and tokenizer caches."""
    return sys.__dict__.setdefault("_crawlscope_worker_state", {})


def powers(which: str) -> Powers:
    state = worker_state()
    if which not in state:
        state[which] = Powers({"bytes": _BYTE_BASE, "words": _WORD_BASE, "points": _POINT_BASE}[which])
    return state[which]


def byte_values(lower: bool) -> np.ndarray:
    """A fixed pseudo-random 64-bit value per byte (A-Z as a-z if ``lower``)."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return values[lower_table()] if lower else values


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``size`` bytes each (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of a slice of rows.

    ``hash``: 64-bit hash per word; ``start``/``end``: byte range of each in
    ``data``; ``first``: index of each row's first word (n+1 entries).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, values: np.ndarray):
        self.data = data
        offsets = offsets - offsets[0]
        n = len(data)
        inside = table[data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[offsets[:-1][offsets[:-1] < n]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = powers("bytes").upto(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * up[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * down[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        self._total, self._down = total, down

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words longer than ``size`` bytes and the hashes of
        their first ``size`` bytes, apart from every word's own hash."""
        which = np.flatnonzero(self.end - self.start > size)
        a = self.start[which]
        with np.errstate(over="ignore"):
            h = (self._total[a + size] - self._total[a]) * self._down[a]
            return which, mix(h + np.uint64(size << 40))

    def window_hashes(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` consecutive words (runs that cross rows
        included: see ``window_rows``)."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, dtype=np.uint64)
        up, down = powers("words").upto(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.hash * up[:n], out=total[1:])
            return mix((total[size:] - total[:-size]) * down[:n - size + 1] + np.uint64(size))

    def rows(self) -> np.ndarray:
        """Row index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows_inside(self, size: int) -> np.ndarray:
        """Mask over ``window_hashes``: the run lies within one row."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, dtype=bool)
        row = self.rows()
        return row[:n - size + 1] == row[size - 1:]


def words_of(data: np.ndarray, offsets: np.ndarray, a: int, b: int, table: np.ndarray, values: np.ndarray) -> Words:
    """Words of rows [a, b)."""
    return Words(data[offsets[a]:offsets[b]], offsets[a:b + 1], table, values)
