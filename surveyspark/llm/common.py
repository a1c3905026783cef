"""Helpers that the operators of this package share: cut plans, size-checked joins, numpy text hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.core.session import cut_lineage

__all__ = ["batches_of", "cut_lineage", "edge_bytes", "mix", "release", "released", "row_hash", "small_join", "text_parts", "partitions"]

#: A side is sent whole to every executor only up to this many bytes; beyond it the join shuffles.
SMALL_SIDE = 32 << 20

_U = np.uint64
_C1, _C2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def batches_of(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that one Arrow batch may hold: long texts make large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: nothing to give back by hand
    _TRIM = None


def release() -> None:
    """Give free memory back: Python workers wait for the next stage with all they have ever taken."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, with its memory given back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_hash(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def small_join(left: DataFrame, small: DataFrame, on: Sequence[str], how: str, width: Column | int = 48, limit: int = SMALL_SIDE) -> DataFrame:
    """Equality join whose right side is broadcast only if its measured size stays below ``limit`` bytes.

    ``small`` must be cheap to read twice (a checkpoint). Beyond the limit both sides are
    shuffled on the keys, with skewed keys split by adaptive execution; the rows are the same.
    """
    size = small.agg(F.sum(F.lit(width) if isinstance(width, int) else width).alias("b")).first()["b"] or 0
    return left.join(F.broadcast(small) if size <= limit else small, list(on), how)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit words."""
    x = x ^ (x >> _U(33))
    x = x * _C1
    x = x ^ (x >> _U(29))
    x = x * _C2
    return x ^ (x >> _U(32))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, kept up to the longest text seen."""

    up = np.ones(1, dtype=_U)
    down = np.ones(1, dtype=_U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = 1 << (n + 1).bit_length()
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                p = np.full(size, base, dtype=_U)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class SubHashes:
    """Hash of any stretch ``[s, e)`` of a symbol array in constant time."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = Powers.of(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, dtype=_U)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(_U) * _C2)


#: One random word for each byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=_U) * _U(BASE))


def edge_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is an empty text."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def text_parts(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about ``limit`` bytes of text (one longer text alone), with bytes and offsets."""
    for batch in batches:
        data, offs = edge_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower case for A-Z only, other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and word offsets of the rows."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    start[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = first - 1
    last = last[last >= 0]
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return SubHashes(BYTE_WORDS[data]).of(s, e), np.searchsorted(s, offs)
