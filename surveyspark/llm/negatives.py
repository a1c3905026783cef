"""Hard negatives by a secondary sort over anchors and scores.

Anchors meet all rows block by block: large candidate blocks stay nearly uncopied, the few
anchors go to each of them, and a block is one matrix product per label. A first round keeps
the best rows of an anchor's own label in each block; the best of all blocks are its positives.
A second round keeps, in each block, the first rows of other labels below each positive.
These pairs and the positives are the secondary sort: keyed by (anchor, falling score, kind,
id), shuffled by anchor, sorted inside partitions. One streaming pass opens a window at each
positive it meets and hands out negatives while windows are open; it holds the open windows
of one anchor and nothing else. (``repartition`` with ``sortWithinPartitions`` is the frame's
form of ``repartitionAndSortWithinPartitions``, sorted by the JVM.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import batches_of, cut_lineage, partitions, small_join
from surveyspark.llm.vectors import matrix

#: Numbers in a block of candidates and in a block of anchors.
CANDIDATE_NUMBERS, ANCHOR_NUMBERS = 1 << 21, 1 << 19
#: Scores that a step of the product may hold at once.
SCORES = 1 << 21

PAIRS = pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])
MINED_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def labelled_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label and integer components v of the rows that take part, one per id (ties: the smallest)."""
    x = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    x = x.withColumn("v", F.transform("v", lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long")))
    return x.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")


def first_of(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties to the smaller place."""
    if len(s) <= k:
        return np.argsort(-s, kind="stable")
    t = np.partition(s, len(s) - k)[len(s) - k]
    more = np.flatnonzero(s > t)
    at = np.concatenate([more, np.flatnonzero(s == t)[: k - len(more)]])
    return at[np.lexsort((at, -s[at]))]


def exact_kind(a: np.ndarray, c: np.ndarray, share: int) -> type:
    """Number type in which products, also times ``share``, are exact; raises beyond 63 bits."""
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, c)]
    bound = most[0] * most[1] * a.shape[1] * share
    if bound >= 1 << 63:
        raise OverflowError("scores beyond 63 bits")
    return np.float64 if bound < 1 << 53 else np.int64


def _products(a: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the anchor, its scores) for all anchors, some at a time."""
    step = max(1, SCORES // max(1, len(c)))
    for s in range(0, len(a), step):
        block = a[s : s + step] @ c.T
        for i in range(len(block)):
            yield s + i, block[i]


def _meet(k: int, low: int, negatives: bool):
    """Pairs of one block: the best of an anchor's label, or the first rows of other labels in its windows."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        v = matrix(table.column("v"), int(table.column("dim")[0].as_py()), np.int64)
        windows = table.column("windows").to_pylist() if negatives else None
        rows = np.flatnonzero(~asks)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        kind = exact_kind(v[asks], v[rows], 100)
        v = v.astype(kind)
        out: list[list] = [[], [], []]
        for label in np.unique(labels[asks]):
            mine = np.flatnonzero(asks & (labels == label))
            own = rows[(labels[rows] != label) if negatives else (labels[rows] == label)]
            if not len(own):
                continue
            near, names = v[own], ids[own]
            for i, s in _products(v[mine], near):
                anchor = int(ids[mine[i]])
                if negatives:
                    got = [np.zeros(0, np.int64)]
                    for w in windows[mine[i]]:
                        inside = np.flatnonzero((s <= w) & (100 * s >= low * w))
                        got.append(inside[first_of(s[inside], k)])
                    at = np.unique(np.concatenate(got))
                else:
                    at = first_of(s, k + 1)
                    at = at[names[at] != anchor][:k]
                out[0] += [anchor] * len(at)
                out[1] += s[at].astype(np.int64).tolist()
                out[2] += names[at].tolist()
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, PAIRS.types)], schema=PAIRS)

    return run


def _stream(positives: int, negatives: int, low: int):
    """Walks pairs sorted by (anchor, falling score, positives first, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, seen = None, [], 0  # a window: [positive, its score, negatives given]
        for batch in batches:
            out: list[list] = [[] for _ in MINED]
            for a, score, kind, i in zip(*(batch.column(n).to_pylist() for n in ("anchor_id", "score", "kind", "id"))):
                if a != anchor:
                    anchor, windows, seen = a, [], 0
                if kind == 0:
                    if seen < positives:
                        windows.append([i, score, 0])
                        seen += 1
                    continue
                still = []
                for w in windows:
                    if 100 * score < low * w[1]:
                        continue  # scores only fall: this window is closed
                    w[2] += 1
                    for o, x in zip(out, (a, w[0], w[2], i, w[1], score)):
                        o.append(x)
                    if w[2] < negatives:
                        still.append(w)
                windows = still
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, MINED.types)], schema=MINED)

    return run


def _blocks(count: Column, numbers: int, spread: int = 1) -> Column:
    """Blocks of vectors: at most ``numbers`` numbers each, and up to ``spread`` of them once there are 1,000 rows for each."""
    return F.greatest(F.ceil(count * F.col("dim") / numbers), F.least(F.ceil(count / 1000), F.lit(spread))).cast("long")


def mine_negatives(
    df: DataFrame, is_anchor: str = "vec_id % 100 = 0", id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of hard negatives.

    Components become ``floor(scale * x)``; a score is the integer inner product with the
    anchor, higher first, ties to the smaller id. An anchor (``is_anchor``, a condition on
    vec_id) has the first ``positives`` other rows of its label as positives; each positive
    gets the first ``negatives`` rows of other labels whose score is at most its own and at
    least ``low`` percent of it (none, if its score is below 0).

    Null ids, null labels, null and empty vectors and those with null or non-finite numbers
    take no part; rows that repeat an id count once, with the smallest vector and label;
    vectors meet only vectors of their own length. Scores of 2^63 / 100 and more raise. An
    empty table gives no rows.
    """
    spark = df.sparkSession
    batches_of(spark, 4096)
    x = labelled_vectors(df, id_col, vec_col, label_col, scale).withColumn("dim", F.size("v"))
    x = cut_lineage(x.withColumn("asks", F.expr(is_anchor)))
    sizes = x.groupBy("dim").agg(F.count(F.lit(1)).alias("c"), F.count_if("asks").alias("a"))
    sizes = sizes.select("dim", _blocks(F.col("c"), CANDIDATE_NUMBERS, 2 * partitions(spark)).alias("cbs"), F.greatest(_blocks(F.col("a"), ANCHOR_NUMBERS), F.lit(1).cast("long")).alias("abs"))
    placed = small_join(x, cut_lineage(sizes), ["dim"], "inner", 24)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("cbs")), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("abs"))
    none = F.lit(None).cast("array<bigint>")
    rows = placed.select("dim", "vec_id", "label", "v", none.alias("windows"), F.lit(False).alias("asks"), own[0].alias("cb"), every("abs").alias("ab"))
    anchors = placed.filter("asks")

    def met(asking: DataFrame, k: int, of_others: bool) -> DataFrame:
        asking = asking.select("dim", "vec_id", "label", "v", "windows", F.lit(True).alias("asks"), own[1].alias("ab"), every("cbs").alias("cb"))
        both = rows.unionByName(asking)
        return both.groupBy("dim", "cb", "ab").applyInArrow(_meet(k, low, of_others), "anchor_id long, score long, id long")

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = met(anchors.withColumn("windows", none), positives, False)
    best = cut_lineage(best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"))
    opened = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("windows"))  # at most `positives`
    found = met(anchors.join(opened, "vec_id"), negatives, True)
    pairs = found.withColumn("kind", F.lit(1)).unionByName(best.withColumn("kind", F.lit(0)))
    dealt = pairs.repartition(partitions(spark), "anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "kind", "id")
    return dealt.select("anchor_id", "score", "kind", "id").mapInArrow(_stream(positives, negatives, low), MINED_DDL)
