"""Sharding by extendible hashing, in DataFrame operations only.

A row's bucket is a prefix of its key's hash. A bucket that exceeds the byte limit is split
on one more bit, others stay as they are, so buckets have depths of their own. Sizes are
added up once at some bits more than the average bucket needs, and the directory (one entry
per prefix of that length) names each prefix's bucket; prefixes that are still too large go
on with further bits, for their rows alone. Rows that share all bits of the hash, such as
rows of one repeated key, can't be split by it: they fill overflow pages of the bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import cut_lineage

BITS = 60
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of the key as text; a null key hashes like the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _level(rows: DataFrame, done: int, bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Directory of the next ``bits`` bits below the prefixes of ``done`` bits: entries, and whether still too large."""
    cell = F.shiftright("h", BITS - done - bits)
    cells = cut_lineage(rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")))
    depth = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d")
    nodes = cells.select("cell", "b", "n", depth).groupBy("d", F.expr(f"shiftright(cell, {bits} - d)").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    large = (F.col("b") > limit) & (F.col("n") > 1)
    inner = nodes.filter(large & (F.col("d") < bits)).select("d", "p")
    # a bucket is a fitting node below a large one, or the node at the start of the level
    sides = inner.select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
    starts = nodes.filter("d = 0").select("d", "p")
    leaves = sides.union(starts).join(inner, ["d", "p"], "left_anti")
    leaves = leaves.join(nodes.select("d", "p", large.alias("large")), ["d", "p"])  # empty buckets have no rows to place
    entries = leaves.select("d", "p", "large", F.explode(F.expr(f"sequence(shiftleft(p, {bits} - d), shiftleft(p + 1, {bits} - d) - 1)")).alias("cell"))
    return cells, cut_lineage(entries.select("cell", (F.col("d") + done).alias("depth"), F.col("p").alias("prefix"), "large"))


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int = LIMIT, bits: int | None = None) -> DataFrame:
    """Each row's key, n_bytes and shard: depth, prefix (the bits of its bucket) and page.

    ``size`` gives the bytes of a row (null: 0). Every shard (depth, prefix, page) stays within
    ``limit`` bytes, except one that a single larger row fills alone. An empty table gives no
    rows; a null key is a key like others; repeated rows stand in the result each. Other
    columns are not read, whatever their names.
    """
    items = cut_lineage(df.select(F.col(f"`{key}`").alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col(f"`{key}`")).alias("h")))
    total = items.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits = bits or min(max(math.ceil(math.log2(max(total / limit, 1))) + 4, 1), 24)
    done, left, placed = 0, items, []
    while True:
        step = min(bits, BITS - done)
        _, directory = _level(left, done, step, limit)
        here = left.join(directory.withColumnRenamed("cell", "__cell"), F.shiftright("h", BITS - done - step) == F.col("__cell")).drop("__cell")
        done += step
        placed.append(here.filter(~F.col("large")).select("key", "n_bytes", "depth", "prefix", F.lit(0).cast("long").alias("page")))
        if directory.filter("large").isEmpty():
            break
        left = cut_lineage(here.filter("large").select("key", "n_bytes", "h"))
        if done == BITS:
            placed.append(_pages(left, limit))
            break
        bits = 8
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select(F.col("key").alias(key), "n_bytes", "depth", "prefix", "page")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows that share a whole hash, numbered in parts so that no key is in one task.

    A page takes the rows that begin in its stretch of ``limit`` less the longest row, so it can't overflow.
    """
    rows = rows.withColumn("part", F.spark_partition_id())
    before = (Window.unboundedPreceding, -1)
    parts = rows.groupBy("h", "part").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("m"))
    over = Window.partitionBy("h")
    parts = parts.select("h", "part", F.coalesce(F.sum("b").over(over.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("from"), F.max("m").over(over).alias("longest"))
    inside = Window.partitionBy("h", "part").orderBy("n_bytes", "key").rowsBetween(*before)
    rows = rows.withColumn("at", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(parts, ["h", "part"])
    page = F.floor((F.col("from") + F.col("at")) / F.greatest(F.lit(limit) - F.col("longest"), F.lit(1)))
    return rows.select("key", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), page.cast("long").alias("page"))
