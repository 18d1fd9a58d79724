"""Words of Arrow text columns as flat numpy arrays: spans, hashes, rolling windows.

All functions work on slices of a quarter of a megabyte, so a task's memory does not grow with the batch;
a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 18
#: Bytes that separate words: space and 0x09 to 0x0D.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that separate tokens: ASCII other than letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Bytes of the Arrow batches that tasks exchange with Python, where the session leaves Spark's default of 64 MB.
#: A task holds several of them at a time, in Python and outside the heap.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session. Changes memory only, never a result."""
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.buffers()[1] is None:
        return np.zeros(len(column) + 1, kind)
    return np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and its row boundaries; null counts as empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = _offsets(column).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(column, limit: int = SLICE_BYTES, prepare=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and row boundaries of slices of about ``limit`` bytes.

    ``prepare`` is applied to each slice of the column.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, first = _offsets(column), 0
    while first < len(column):
        last = int(np.searchsorted(offsets, int(offsets[first]) + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        part = column.slice(first, last - first)
        yield first, last, *utf8(prepare(part) if prepare else part)
        first = last
    pa.default_memory_pool().release_unused()  # workers are used again and would keep their peak


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
    """Starts and ends of all words, and for each row the number of words before it."""
    inside = ~blank[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


def _range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each range of ``values``, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), _STEP), out=total[1:])
    return (total[ends] - total[starts]) * _powers(len(values) + 1, _BACK)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(_range_sums(_BYTES[data], starts, ends) + (ends - starts).astype(np.uint64))


def windows(first: np.ndarray, k: int) -> np.ndarray:
    """Start words of all windows of ``k`` words that stay within a row.

    ``first``: number of words before each row, with the total at the end.
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    return np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each start."""
    return mix(_range_sums(hashes, at, at + k))


def runs(values: np.ndarray) -> np.ndarray:
    """Boundaries of runs of equal values, with 0 and the length."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
