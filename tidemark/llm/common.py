"""Helpers shared by the text operators: scratch tables, Arrow text buffers, word spans and hashes."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import delete, scratch_path

#: ASCII white space: the bytes 0x09 to 0x0D and 0x20.
SPACE_BYTES = b"\x09\x0a\x0b\x0c\x0d\x20"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True

#: Odd multiplier of the polynomial byte hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


class _Open(threading.local):
    """Folders of tables written within each ``temporary`` that a thread of the driver has open."""

    def __init__(self) -> None:
        self.stack: list[list[str]] = []


_OPEN = _Open()


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, which cuts its lineage: a lost executor costs no more than a reread. ``keep``: it outlives the innermost ``temporary``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if len(_OPEN.stack) > keep:
        _OPEN.stack[-1 - keep].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are deleted at the end, but for those to keep."""
    _OPEN.stack.append([])
    try:
        yield
    finally:
        for path in _OPEN.stack.pop():
            delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Arrow batches of a few megabytes, as rows here carry whole texts. It holds for the session; ``bounded_batches`` puts it back."""
    spark.conf.set(_ROWS, rows)
    spark.conf.set(_BYTES, size)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for what is executed within; the session's own settings are restored."""
    before = {k: spark.conf.get(k) for k in (_ROWS, _BYTES)}
    bound_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def narrow_reads(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Parquet is read in batches of ``rows`` for what is executed within. Spark's own 4,096 whole texts make arrays of tens of megabytes, by which an executor's heap grows and stays."""
    before = spark.conf.get(_READ)
    spark.conf.set(_READ, rows)
    try:
        yield
    finally:
        spark.conf.set(_READ, before)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks and would hold it beside the next ones."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts have about ``max_bytes`` together; one longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    give_back()
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end
    give_back()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column (null: empty) as one array, and the n + 1 offsets of its rows in it."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all runs of bytes that aren't ASCII white space. Runs end with their row."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    cut = cut[inside[cut] & inside[cut + 1]]
    first[cut] = last[cut] = True
    starts, ends = np.flatnonzero(first[:n]), np.flatnonzero(last)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class ByteHasher:
    """64-bit hashes of spans of a byte array from prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self._powers = self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 2 * len(self._powers), 1 << 16)
            self._powers = _power_table(_BASE, n)
            self._inverse = _power_table(_BASE_INV, n)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A mixed hash for each [start, end)."""
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values differ in all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words. A row with fewer words, but not none, has its whole sequence as one shingle."""
    counts = np.bincount(rows, minlength=n_rows)
    weights = _power_table(0xC2B2AE3D27D4EB4F, size + 1)
    if len(words) >= size:
        mixed = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            mixed += words[j : len(words) - size + 1 + j] * weights[j + 1]
        whole = rows[: len(mixed)] == rows[size - 1 :]
        out, at = mixed[whole], rows[: len(mixed)][whole]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (counts > 0) & (counts < size)
    if short.any():
        firsts = np.cumsum(counts) - counts
        place = np.arange(len(words)) - firsts[rows]
        terms = words * weights[np.minimum(place, size - 1) + 1]
        pick = short[rows]
        sums = np.zeros(n_rows, np.uint64)
        np.add.at(sums, rows[pick], terms[pick])
        extra = np.flatnonzero(short)
        out, at = np.concatenate([out, sums[extra]]), np.concatenate([at, extra])
    return mix64(out), at
