"""Vectorised text kernels over Arrow string buffers.

All of them look at the raw UTF-8 bytes of a whole batch of texts at once, so that a word costs a few array operations
and no Python object. A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``; words never span texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 18
_powers = {1: (np.ones(1, U64), np.ones(1, U64))}

#: Rows that one Arrow batch carries to Python. With whole texts of up to hundreds of KB it bounds a worker's memory.
BATCH_ROWS = 256


def bound_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def lean(run):
    """A batch function that gives its memory back when its input ends.

    Workers are kept for later tasks, and the allocator would keep what the largest batch took for them."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers[1]
    if len(up) < n:
        size = 1 << (n - 1).bit_length()
        factors = np.full(size, _BASE, U64)
        factors[0] = 1
        up = np.multiply.accumulate(factors)
        factors = np.full(size, _BASE_INVERSE, U64)
        factors[0] = 1
        down = np.multiply.accumulate(factors)
        _powers[1] = (up, down)
    return up, down


def slice_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``buf[start:end]``; starts ascend. Equal bytes give equal hashes wherever they stand.

    ``end`` may have more rows, each with other ends for the same starts; so has the result.
    """
    out = np.empty(end.shape, U64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + _SPAN)))
        hi = int(end[..., i:j].max())
        up, down = _power_tables(hi - lo + 1)
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum((buf[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[..., i:j] - lo
        out[..., i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and each text's offsets in it. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


@dataclass
class Words:
    """Words of a batch in order: byte range, and the row each belongs to. ``row_start[i]`` is row i's first word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    row_start: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_start)

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.buf, self.start, self.end)


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    n, rows = len(buf), len(offsets) - 1
    inside = ~separator[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row_start = np.searchsorted(start, offsets)
    return Words(buf, start, end, np.repeat(np.arange(rows), np.diff(row_start)), row_start)


def joined(w: Words) -> Words:
    """The same words with a single space between those of a row and nothing else in the buffer."""
    inside = np.zeros(len(w.buf) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    inside[w.end] -= 1
    keep = np.cumsum(inside[:-1]).astype(bool)
    first = np.zeros(len(w.start), bool)
    first[w.row_start[:-1][w.counts > 0]] = True
    gaps = w.start[~first] - 1
    keep[gaps] = True
    place = np.cumsum(keep) - keep
    buf = w.buf.copy()
    buf[gaps] = 0x20
    start = place[w.start] if len(w.start) else w.start
    return Words(buf[keep], start, start + (w.end - w.start), w.row, w.row_start)


def runs(row_start: np.ndarray, width: int) -> np.ndarray:
    """Indices of the first items of all windows of ``width`` items that stay inside their row."""
    counts = np.diff(row_start)
    n = int(row_start[-1])
    left = np.repeat(row_start[1:], counts) - np.arange(n)
    return np.flatnonzero(left >= width)


def sums(values: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for empty rows. Each sum sees its own row's values only, so floats don't drift."""
    out = np.zeros(len(row_start) - 1, values.dtype if values.dtype.kind == "f" or values.dtype == U64 else np.int64)
    full = np.flatnonzero(np.diff(row_start))
    if len(full):
        out[full] = np.add.reduceat(values.astype(out.dtype, copy=False), row_start[:-1][full])
    return out


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most_bytes`` at most; one longer text makes a slice by itself."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
