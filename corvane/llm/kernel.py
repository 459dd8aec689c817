"""Vectorised text kernels over Arrow string buffers, used by the operators that run in Python.

A batch of texts is handled as one byte array with document offsets; words, word hashes and shingles of
all its documents come out of a few NumPy passes, in pieces of half a megabyte so that memory stays
bounded.  Hashes are 64 bits wide and equal on every worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 19
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"n": 0}


def tidy(run: Callable) -> Callable:
    """A batch function whose worker gives its memory back when it ends: idle workers stay small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, PIECE_BYTES + 1)
        ones = np.full(size, _R, np.uint64)
        ones[0] = 1
        inverse = np.full(size, _R_INV, np.uint64)
        inverse[0] = 1
        _powers.update(n=size, p=np.cumprod(ones), i=np.cumprod(inverse))
    return _powers["p"], _powers["i"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most rows documents with about limit bytes; a longer document is a piece of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, first + rows)
        yield first, last
        first = last


class Words:
    """Words of the documents of one piece: byte ranges, document index, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.n_docs = len(offsets) - 1
        n = len(data)
        self.data = LOWER[data] if lower else data
        solid = ~BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~solid[:-1]
            after[-1], after[:-1] = True, ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:n]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        if len(self.start):
            power, inverse = _power(n + 1)
            value = BYTE_CODE[self.data]
            value *= power[:n]
            value[~solid] = 0
            self.hash = mix(np.add.reduceat(value, self.start) * inverse[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, hash) of k-word shingles, sorted; a shorter text is one shingle of all its words."""
        h = self.hash
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(h)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled[: n - j] = rolled[: n - j] * U(0x100000001B3) + h[j:]
        room = self.first[1:][self.doc] - np.arange(n)
        whole = room >= k
        out, docs = rolled[whole], self.doc[whole]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for m, d in enumerate(short):
                x = int(self.count[d])
                for y in h[self.first[d] : self.first[d + 1]].tolist():
                    x = ((x * 0x100000001B3 + y) ^ 0xA5A5) & 0xFFFFFFFFFFFFFFFF
                extra[m] = x
            out, docs = np.concatenate((out, extra)), np.concatenate((docs, short))
        out = mix(out)
        order = np.lexsort((out, docs))
        out, docs = out[order], docs[order]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != out[:-1]) | (docs[1:] != docs[:-1])
        return docs[keep], out[keep]


def word_pieces(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(column)
    with np.errstate(over="ignore"):
        for a, b in pieces(offsets):
            yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
