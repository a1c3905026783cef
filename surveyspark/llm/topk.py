"""Exact inner-product search: norm-sorted blocks, partial sums and residual bounds.

Vectors are turned by the singular directions of a bounded sample, so that most of an inner
product comes with its first columns (any rotation keeps inner products, so the sample
decides speed only). Candidates are cut into bands of falling length. The longest band gives
each query a k-th best score to beat; a query then goes to the bands whose length times its
own can reach that score. Inside a block, candidates go by falling length until the product
of lengths can't reach the k-th best, and between column blocks those go whose partial sum
plus the product of the remaining lengths (Cauchy-Schwarz) can't. Scores are integers
computed on the original numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import batches_of, cut_lineage, partitions
from surveyspark.llm.vectors import all_blocks, best, block_of, common_length, fit_sample, matrix, usable

BANDS, CANDIDATES, QUERIES = 32, 4096, 256
#: Rounding of the bounds, relative to the product of lengths.
SLACK = 1e-9
LOWEST = -(1 << 62)


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, strongest direction first."""
    return np.linalg.svd(sample.T @ sample)[0]


def _tails(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Length of what follows each edge."""
    return np.stack([np.sqrt((x[:, e:] ** 2).sum(axis=1)) for e in edges], axis=1)


def scan(q: np.ndarray, q_tail: np.ndarray, c: np.ndarray, c_tail: np.ndarray, edges: list[int], exact, skip: np.ndarray, ids: np.ndarray, k: int, low: int, chunk: int = 512) -> list[tuple[int, int]]:
    """Best (score, id) pairs among candidates sorted by falling length.

    ``exact`` gives integer scores of places; ``low`` is a score that k rows reach for sure.
    """
    top: list[tuple[int, int]] = []
    for s in range(0, len(c), chunk):
        slack = SLACK * q_tail[0] * c_tail[s, 0] + 1e-6
        if q_tail[0] * c_tail[s, 0] + slack < low:
            break
        alive = np.arange(s, min(s + chunk, len(c)))
        alive = alive[~skip[alive]]
        partial = np.zeros(len(alive))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            partial += c[alive, a:b] @ q[a:b]
            can = partial + c_tail[alive, i + 1] * q_tail[i + 1] + slack >= low
            alive, partial = alive[can], partial[can]
            if not len(alive):
                break
        if len(alive):
            scores = exact(alive)
            top += zip((-scores).tolist(), ids[alive].tolist())
            top = sorted(top)[:k]
            if len(top) == k:
                low = max(low, -top[-1][0])
    return [(-s, i) for s, i in top]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(rotation: np.ndarray, k: int):
    size = len(rotation)
    edges = [*range(0, size, max(8, size // 4)), size]

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, low = table.column("vec_id").to_numpy(), table.column("low").to_numpy()
        v = matrix(table.column("v"), size, np.int64)
        turned = v.astype(np.float64) @ rotation
        tails = _tails(turned, edges)
        out: list[list] = [[], [], []]
        order = np.lexsort((ids, -tails[:, 0], part))
        cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
        for group in np.split(order, cut[1:]):
            c = group[~asks[group]]
            rows, lens, own = turned[c], tails[c], ids[c]
            for i in group[asks[group]]:
                got = scan(turned[i], tails[i], rows, lens, edges, lambda at: v[c[at]] @ v[i], own == ids[i], own, k, int(low[i]))
                out[0] += [ids[i]] * len(got)
                out[1] += [x for _, x in got]
                out[2] += [s for s, _ in got]
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, FOUND.types)], schema=FOUND)

    return run


def largest_products(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest integer inner products for each query.

    Components become ``floor(scale * x)``; products of lengths must stay below 2^62.
    ``is_query`` is a condition on ``vec_id``. See ``vectors.usable`` for rows that take no
    part (zero vectors do here); an empty table gives no rows.
    """
    spark = df.sparkSession
    batches_of(spark, 4096)
    x = usable(df, id_col, vec_col, zero=True)
    x = x.select("vec_id", F.transform("v", lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))
    x = x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)))
    x = cut_lineage(x)
    size = common_length(x)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    x = x.filter(F.size("v") == size)
    rotation = rotation_of(fit_sample(x.select("vec_id", "v"), size))
    cuts = x.agg(F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 10000).alias("c")).first()["c"]
    cuts = sorted(set(cuts), reverse=True)
    band = sum((F.when(F.col("norm") < F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))  # 0: the longest
    placed = cut_lineage(x.withColumn("band", band))
    sizes = cut_lineage(placed.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.max("norm").alias("longest")))  # at most BANDS rows
    bands = {r["band"]: r["longest"] for r in sizes.collect()}
    asked = x.filter(is_query)
    search = _search(rotation, k)
    buckets = 4 * partitions(spark)

    def found(asks: DataFrame, only) -> DataFrame:
        """Scores of queries (vec_id, v, low, band) against the bands they name."""
        asks = cut_lineage(asks)
        both = cut_lineage(sizes.join(asks.groupBy("band").agg(F.count(F.lit(1)).alias("q")), "band"))
        c, q = F.col("c"), F.col("q")
        own = placed.filter(only).join(F.broadcast(both), "band").select("band", "vec_id", "v", F.lit(LOWEST).alias("low"), block_of(c, CANDIDATES, 1).alias("cb"), all_blocks(q, QUERIES).alias("qb"), F.lit(False).alias("asks"))
        ask = asks.join(F.broadcast(both), "band").select("band", "vec_id", "v", "low", block_of(q, QUERIES, 2).alias("qb"), all_blocks(c, CANDIDATES).alias("cb"), F.lit(True).alias("asks"))
        rows = own.unionByName(ask).withColumn("part", F.xxhash64("band", "cb", "qb"))
        rows = rows.withColumn("bucket", F.pmod("part", F.lit(buckets))).select("bucket", "part", "vec_id", "v", "low", "asks")
        return best(rows.groupBy("bucket").applyInArrow(search, "query_id long, vec_id long, score long"), k, largest=True)

    head = min(bands)
    first = cut_lineage(found(asked.select("vec_id", "v", F.lit(LOWEST).alias("low"), F.lit(head).alias("band")), F.col("band") == head).drop("rank"))
    beat = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("low"))
    asked = asked.join(beat, "vec_id", "left").withColumn("low", F.coalesce("low", F.lit(LOWEST)))
    reach = [F.when(F.col("norm") * F.lit(n) * (1 + SLACK) + 1e-6 >= F.col("low"), F.lit(b)) for b, n in sorted(bands.items()) if b != head]
    if not reach:
        return best(first, k, largest=True).select("query_id", "rank", "vec_id", "score")
    rest = asked.select("vec_id", "v", "low", F.explode(F.filter(F.array(*reach), lambda b: b.isNotNull())).alias("band"))
    return best(first.unionByName(found(rest, F.col("band") != head).drop("rank")), k, largest=True).select("query_id", "rank", "vec_id", "score")
