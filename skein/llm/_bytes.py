"""Vectorised work on the UTF-8 bytes of a column: words, hashes and documents in blocks."""

from __future__ import annotations

import ctypes
import functools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of words: digits, lower-case letters and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("0") : ord("9") + 1] = WORD_BYTE[ord("a") : ord("z") + 1] = WORD_BYTE[128:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes other than ASCII white space.
SOLID_BYTE = np.ones(256, bool)
SOLID_BYTE[[9, 10, 11, 12, 13, 32]] = False


class Shared:
    """A broadcast object of a class of this package, sent with the code of its class."""

    def __init__(self, df: DataFrame, value: object) -> None:
        self._sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._sent.value)
        return self._value


def small_batches(df: DataFrame) -> None:
    """Have Spark send rows to Python in batches of at most 1,000 rows and 8 MB, as they may hold whole long texts."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = conf.get(key, None)
        if now is None or not 0 < int(str(now).rstrip("bB")) <= most:
            conf.set(key, str(most))


def tidy(run: Callable) -> Callable:
    """A task function that gives memory back when it ends: Spark keeps Python workers for later tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


class Spans:
    """Hashes of any spans of one byte buffer; equal bytes give equal hashes in every buffer."""

    def __init__(self, buf: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in ``member``; runs end with their row."""
    inside = member[buf]
    edges = np.zeros(len(buf) + 1, bool)
    edges[offsets] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edges[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
