"""Nearest neighbours by adaptive dimension scan inside the probed lists of an index.

Lists are cells of k-means centroids fitted on a bounded sample; every row is placed. The
number of lists a query probes is the smallest that keeps ``recall`` of the neighbours of
sample rows. In a list, randomly rotated vectors are read in column blocks: the distance on
the first t of d rotated numbers, scaled by d/t, estimates the whole one, and a candidate is
abandoned as soon as a test of that estimate against the k-th best distance so far fails.
Distances of the survivors are computed on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import batches_of, cut_lineage, partitions
from surveyspark.llm.vectors import all_blocks, best, block_of, common_length, fit_sample, matrix, usable

MOST_LISTS, ROWS_PER_LIST, PROBE_RECALL = 1024, 24, 0.97
CANDIDATES, QUERIES = 4096, 256
#: Strictness of the abandoning test: a true neighbour fails it with a probability far below 1 %.
EPSILON = 2.5


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    g = np.random.default_rng(seed)
    c = x[g.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centroids(x, c, 1)[:, 0]
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], k)
            n = np.bincount(near, minlength=k)
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def nearest_centroids(x: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """The p nearest centroids of each row, nearest first."""
    out = np.empty((len(x), p), np.int64)
    half = (c * c).sum(axis=1) / 2
    for s in range(0, len(x), 4096):
        d = half - x[s : s + 4096] @ c.T
        out[s : s + 4096] = np.argsort(d, axis=1, kind="stable")[:, :p]
    return out


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, asked: int = 300) -> int:
    """Lists to probe so that ``recall`` of the k nearest sample rows of sample queries are met."""
    q = x[:: max(1, len(x) // asked)][:asked]
    home = nearest_centroids(x, c, 1)[:, 0]
    order = nearest_centroids(q, c, len(c))
    place = np.argsort(order, axis=1)  # place of each list in the order of a query
    half = (x * x).sum(axis=1) / 2
    needed = []
    for i, row in enumerate(q):
        d = half - x @ row
        near = np.argpartition(d, min(k, len(x) - 1))[: k + 1]
        needed.append(place[i][home[near]])
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


def _assign(centroids: np.ndarray, size: int):
    def run(batches):
        for batch in batches:
            near = nearest_centroids(matrix(batch.column("v"), size), centroids, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near)], names=["vec_id", "v", "list"])

    return run


def _probe(centroids: np.ndarray, size: int, probes: int):
    def run(batches):
        for batch in batches:
            near = nearest_centroids(matrix(batch.column("v"), size), centroids, probes) if batch.num_rows else np.zeros((0, probes), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v", "lists"])

    return run


def scan(q: np.ndarray, c: np.ndarray, k: int, step: int, chunk: int = 512) -> np.ndarray:
    """Places of candidates that may be among the k nearest of ``q`` (rotated alike)."""
    size = len(q)
    kept_at, kept_d = np.zeros(0, np.int64), np.zeros(0)
    for s in range(0, len(c), chunk):
        alive = np.arange(s, min(s + chunk, len(c)))
        far = np.partition(kept_d, k - 1)[k - 1] if len(kept_d) >= k else np.inf
        partial = np.zeros(len(alive))
        for t in range(0, size, step):
            to = min(t + step, size)
            diff = c[alive, t:to] - q[t:to]
            partial += np.einsum("ij,ij->i", diff, diff)
            if to < size and np.isfinite(far):
                pass_ = partial * (size / to) <= far * (1 + EPSILON / np.sqrt(to)) ** 2
                alive, partial = alive[pass_], partial[pass_]
                if not len(alive):
                    break
        kept_at, kept_d = np.append(kept_at, alive), np.append(kept_d, partial[: len(alive)])
        if len(kept_d) > k:  # those clearly beyond the k-th go; near ties stay for the exact distances
            near = kept_d <= np.partition(kept_d, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
            kept_at, kept_d = kept_at[near], kept_d[near]
    return kept_at


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(rotation: np.ndarray, k: int):
    size = len(rotation)
    step = max(16, size // 8)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, v = table.column("vec_id").to_numpy(), matrix(table.column("v"), size)
        turned = v @ rotation
        out: list[list] = [[], [], []]
        order = np.lexsort((ids, part))
        cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
        for group in np.split(order, cut[1:]):
            c = group[~asks[group]]
            rows = turned[c]
            for i in group[asks[group]]:
                own = c[scan(turned[i], rows, k + 1, step)]  # one more: the query itself may be among them
                own = own[ids[own] != ids[i]]
                diff = v[own] - v[i]
                d = np.sqrt((diff * diff).sum(axis=1))
                top = np.lexsort((ids[own], d))[:k]
                out[0] += [ids[i]] * len(top)
                out[1] += ids[own][top].tolist()
                out[2] += d[top].tolist()
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, FOUND.types)], schema=FOUND)

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = PROBE_RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each query.

    ``is_query`` is a condition on ``vec_id``. See ``vectors.usable`` for rows that take no
    part; an empty table gives no rows. A list (or its queries) with many rows, such as
    copies of one vector, is searched in blocks of bounded size.
    """
    spark = df.sparkSession
    batches_of(spark, 4096)
    x = cut_lineage(usable(df, id_col, vec_col, zero=False))
    size = common_length(x)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    x = x.filter(F.size("v") == size)
    sample = fit_sample(x, size)
    rows = x.count()
    lists = max(1, min(MOST_LISTS, int(np.sqrt(rows)), len(sample) // ROWS_PER_LIST))
    centroids = kmeans(sample, lists)
    probes = probes_for(sample, centroids, k, recall)
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))[0]
    kind = x.schema["v"].dataType.simpleString()

    placed = cut_lineage(x.mapInArrow(_assign(centroids, size), f"vec_id long, v {kind}, list long"))
    asked = x.filter(is_query).mapInArrow(_probe(centroids, size, probes), f"vec_id long, v {kind}, lists array<long>")
    asked = cut_lineage(asked.select("vec_id", "v", F.explode("lists").alias("list")))
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("c")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list")
    sizes = cut_lineage(sizes)  # at most MOST_LISTS rows
    c, q = F.col("c"), F.col("q")
    own = placed.join(F.broadcast(sizes), "list").select("list", "vec_id", "v", block_of(c, CANDIDATES, 1).alias("cb"), all_blocks(q, QUERIES).alias("qb"), F.lit(False).alias("asks"))
    ask = asked.join(F.broadcast(sizes), "list").select("list", "vec_id", "v", block_of(q, QUERIES, 2).alias("qb"), all_blocks(c, CANDIDATES).alias("cb"), F.lit(True).alias("asks"))
    both = own.unionByName(ask).withColumn("part", F.xxhash64("list", "cb", "qb"))
    both = both.withColumn("bucket", F.pmod("part", F.lit(4 * partitions(spark)))).select("bucket", "part", "vec_id", "v", "asks")
    found = both.groupBy("bucket").applyInArrow(_search(rotation, k), "query_id long, vec_id long, score double")
    return best(found, k, largest=False).select("query_id", "rank", "vec_id", "score")
