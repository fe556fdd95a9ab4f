"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, that is the
regular expression ``[^\\x20\\x09-\\x0D]+``. All work is done on the bytes of a
bounded slice of rows, so memory does not depend on how many rows a batch has;
one very long text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the polynomial word hash, its inverse modulo 2**64, and a shingle multiplier.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_K = np.uint64(0xD6E8FEB86659FD93)


def bounded(run: Callable) -> Callable:
    """Gives memory that a task has freed back to the system when the task ends; the worker process stays."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of about ``limit`` text bytes, with their text as large_string without nulls."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(text):
        return
    ends = np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))
    start = 0
    while start < len(text):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start), text.slice(start, stop - start)
        start = stop


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array, and the offsets of its rows in them."""
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of some rows: ``row_start[i]:row_start[i+1]`` are the words of row i."""

    def __init__(self, text: pa.Array, table: np.ndarray | None = None):
        """``table``: maps each byte to another before the words are taken (None: unchanged)."""
        data, off = raw_bytes(text)
        if table is not None:
            data = table[data]
        self.data, self.off = data, off
        solid = ~_SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[-1] = True, True
        np.not_equal(solid[1:], solid[:-1], out=edge[1:-1]) if len(data) else None
        edge[off] = True
        at = np.flatnonzero(edge)
        first = at[:-1][solid[at[:-1]]] if len(data) else np.zeros(0, np.int64)
        last = at[1:][solid[at[:-1]]] if len(data) else np.zeros(0, np.int64)
        self.start, self.end, self.solid = first, last, solid
        self.row_start = np.searchsorted(first, off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.row_start)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word, mixed. Equal words have equal hashes in any batch."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        with np.errstate(over="ignore"):
            power, inverse = _powers(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
            return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def coded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words as a large_binary array, and the code of each word."""
        lengths = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=lengths[1:])
        packed = np.ascontiguousarray(self.data[self.solid])
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(lengths), pa.py_buffer(packed)])
        coded = array.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy()


_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            made = []
            for r in (_R, _R_INV):
                p = np.full(size, r, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
        _cache[:] = made
        if size > 4 * SLICE_BYTES:  # a single very long text; its table is not kept
            out = _cache[0], _cache[1]
            _cache.clear()
            return out
    return _cache[0], _cache[1]


def shingles(hashes: np.ndarray, row_start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``width``-word shingles of each row, sorted in each row, and the rows' offsets.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    counts = np.diff(row_start)
    out, sizes = [], np.zeros(len(counts) + 1, np.int64)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled = (rolled + hashes[j : j + n]) * _K
        rolled = mix(rolled)
        for i, c in enumerate(counts):
            s = row_start[i]
            if c >= width:
                own = np.sort(rolled[s : s + c - width + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            elif c:
                short = np.uint64(c)
                for h in hashes[s : s + c]:
                    short = (short + h) * _K
                own = mix(np.array([short], np.uint64))
            else:
                own = hashes[:0]
            out.append(own)
            sizes[i + 1] = len(own)
    return (np.concatenate(out) if out else hashes[:0]), np.cumsum(sizes)
