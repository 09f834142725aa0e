"""Vectorised text kernels that run inside Spark tasks on Arrow string buffers.

All word rules used here separate words by ASCII bytes only, so they can be applied to UTF-8
bytes directly: every byte of a non-ASCII character is a word byte under both rules.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
_BYTES = np.arange(256, dtype=np.uint8)
#: Words are runs of anything but ASCII white space.
SPACED = ~np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])
#: Words are runs of ASCII letters, digits and all non-ASCII characters (after lower-casing A-Z).
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _SEGMENT + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What to call when a worker turns to a task that has no use for the caches of earlier tasks.
FORGET: list[Callable[[], None]] = []


def forget() -> None:
    for clear in FORGET:
        clear()
    trim()


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers wait for their next task with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


@cache
def _libc():
    name = ctypes.util.find_library("c")
    libc = ctypes.CDLL(name) if name else None
    return libc if hasattr(libc, "malloc_trim") else None


def trimmed(function: Callable) -> Callable:
    """A partition function that trims its worker when it is done."""

    def run(batches):
        yield from function(batches)
        trim()

    return run


#: Bytes of an Arrow batch between Spark and its workers.
BATCH_BYTES = 6 << 20


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session from now on sends batches of bounded size: ten thousand long texts would fill both sides' memory."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def portions(batch: pa.RecordBatch, text_index: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``most`` text bytes (a longer single text is a slice of its own)."""
    _, offsets = buffers(batch.column(text_index))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """The words of a slice of texts: byte spans, row of each word and a 64-bit hash of its bytes."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool):
        data, offsets = buffers(column)
        self.data = LOWER[data] if lower else data
        self.rows = len(offsets) - 1
        inside = kind[self.data]
        first = np.zeros(len(inside) + 1, bool)  # a text begins here: a word can't go on
        first[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # word index at which each row begins
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), U64)
        i = 0
        while i < len(out):
            a = self.start[i]
            j = max(int(np.searchsorted(self.start, a + _SEGMENT)), i + 1)
            b = self.end[j - 1]
            power, inverse = _power_tables(int(b - a) + 1)
            sums = np.zeros(b - a + 1, U64)
            np.cumsum((self.data[a:b].astype(U64) + U64(1)) * power[: b - a], out=sums[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
            i = j
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words that stays in one row."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, U64)
        at = np.flatnonzero(self.row[:size] == self.row[n - 1 :])
        return at, self.gram_at(at, n)

    def gram_at(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words that begin at ``at``."""
        total = np.full(len(at), n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, U64)
        for k in range(n):
            total = total * U64(0xE7037ED1A0B428DB) + self.hash[at + k]
        return mix(total)

    def span(self, at: int, n: int) -> bytes:
        """The words at ``at`` .. ``at + n``, joined by one space."""
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(at, at + n))


def map_texts(docs: DataFrame, columns: list[str], function: Callable, schema, caches: bool = False, most: int = 2 << 20) -> DataFrame:
    """Run ``function(batch) -> iterable of batches`` over Arrow slices of bounded text size.

    The last of ``columns`` is the text; only ``columns`` are read, so other columns never clash.
    Unless the function uses ``caches``, a worker lets go of those of earlier tasks first.
    """
    text_index = len(columns) - 1

    def run(batches):
        if not caches:
            forget()
        for batch in batches:
            for part in portions(batch, text_index, most):
                yield from function(part)

    return in_batches(docs).select(*columns).mapInArrow(trimmed(run), schema)
