"""What both vector searches share: rows that take part, bounded samples, blocks of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and numbers that a fit may read at most.
FIT_ROWS, FIT_NUMBERS = 20_000, 4_000_000


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """vec_id and v of the rows that take part.

    Left out: null ids, null and empty vectors, those holding null or non-finite numbers, all
    zeros unless ``zero``, and vectors of another length than most have (ties: the smaller
    length). Rows that repeat an id count once, with the smallest vector.
    """
    x = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = x.filter(finite if zero else finite & F.exists("v", lambda e: e != 0))
    return x.groupBy("vec_id").agg(F.min("v").alias("v"))


def common_length(x: DataFrame) -> int:
    row = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return row[0]["d"] if row else 0


def matrix(column: pa.ChunkedArray | pa.Array, size: int, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(-1, size), dtype=kind)


def fit_sample(x: DataFrame, size: int, rows: int = FIT_ROWS) -> np.ndarray:
    """At most ``rows`` vectors (and FIT_NUMBERS numbers), those with the smallest hash of their id."""
    n = max(1, min(rows, FIT_NUMBERS // size))
    return matrix(x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("v").toArrow().column("v"), size)


def block_of(count: Column, size: int, salt: int) -> Column:
    """Block of a row in a part of ``count`` rows, so that a block has about ``size``."""
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.greatest(F.ceil(count / size), F.lit(1)))


def all_blocks(count: Column, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(count / size), F.lit(1)) - 1))


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best rows of each query, ties to the smaller vec_id; map tasks keep k of each first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
