"""Words, shingles and spans of whole texts as numpy arrays over UTF-8 bytes.

A word is a run of bytes outside space and U+0009-U+000D. Continuation bytes of UTF-8 are all above
0x7F, so the byte rule equals the rule on code points. Batches are cut into blocks of bounded bytes;
a document is never cut.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_SHINGLE = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 65536)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _POWERS[i] = np.multiply.accumulate(table)
    return _POWERS


@dataclass
class Words:
    """The words of a block of documents, in order.

    data: the bytes, each document followed by one space. start, end: of each word in data. first: index
    of each document's first word, and the number of words at the end. span: of each document in data.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    span: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every block."""
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(U64) * _SHINGLE)


def trim() -> None:
    """Give the system back what this process has freed; C libraries other than glibc keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def trimmed(run: Callable) -> Callable:
    """Decorates what a worker runs over batches or on a group. Spark keeps a worker idle for a minute after its task, with all that it
    has not given back; so it does that after each batch and group."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            trim()

    @functools.wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(passed(batches))
        finally:
            trim()

    @functools.wraps(run)
    def group(frame):
        try:
            return run(frame)
        finally:
            trim()

    return lean if inspect.isgeneratorfunction(run) else group


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of a string column; null is empty. Each block holds at most
    `limit` bytes or one document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        to = min(to, len(column))
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE) -> Words:
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 0x20, np.uint8)
    place = np.ones(len(spaced), bool)
    span = offsets + np.arange(n + 1)
    place[span[1:] - 1] = False
    spaced[place] = _LOWER[data] if lower else data
    inside = np.zeros(len(spaced) + 1, np.int8)
    inside[1:] = ~separators[spaced]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Words(spaced, start, end, np.searchsorted(start, span), span)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of k words; a document of 1 to k-1 words has one run of all."""
    n = np.diff(first)
    if len(hashes) == 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    powers = np.multiply.accumulate(np.full(k, _SHINGLE, U64))
    doc = np.repeat(np.arange(len(n)), n)
    full = max(0, len(hashes) - k + 1)
    h = np.zeros(full, U64)
    for j in range(k):
        h += hashes[j : j + full] * powers[j]
    h = mix(h + U64(k))
    keep = doc[:full] == doc[k - 1 : k - 1 + full]
    out_doc, out = doc[:full][keep], h[keep]
    if len(short := np.flatnonzero((n > 0) & (n < k))):
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = n[short] > j
            extra[has] += hashes[first[short[has]] + j] * powers[j]
        extra = mix(extra + n[short].astype(U64))
        out_doc, out = np.concatenate([out_doc, short]), np.concatenate([out, extra])
        order = np.argsort(out_doc, kind="stable")
        out_doc, out = out_doc[order], out[order]
    return out_doc, out


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, ascending."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
