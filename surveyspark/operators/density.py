"""Density hierarchy of vectors: near neighbours, mutual reachability, condensed clusters by stability.

Every row has its ``k`` nearest neighbours, searched in the leaves of some random projection
trees (all rows in one leaf when there are few: then they are exact). The distance to the
``min_samples``-th is its core distance; two neighbours reach each other at the largest of
their distance and both core distances. Merging along these edges from the shortest on gives
the hierarchy. Only groups of at least ``min_cluster_size`` rows count as clusters; smaller
ones fall out of the cluster they are next to, at the level where they would join it. A
cluster's stability adds up how much longer its rows hold together than it has been apart
from its sibling, and the clusters with the largest sum of stabilities are taken.

Merging walks the edges in chunks of bounded size, shortest first. A chunk is one task, and
what it hands on is one row of state for every group it has touched, so neither the edges nor
the hierarchy are ever in one place. Selection climbs the table of clusters by doubling steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.core.session import cut_lineage, settle

#: Rows of a leaf, trees, and edges of a chunk.
LEAF, TREES, CHUNK = 1024, 6, 500_000
#: Distances below count as this one, so that copies have a finite density.
SHORTEST = 1e-9


def _planes(spark, trees: int, size: int, levels: range, seed: int) -> DataFrame:
    """tree and its random directions of some levels."""
    drawn = [np.random.default_rng([seed, level]).normal(size=(trees, size)) for level in levels]
    rows = [(t, [d[t].tolist() for d in drawn]) for t in range(trees)]
    return spark.createDataFrame(rows, "tree int, planes array<array<double>>")


def _leaves(rows: DataFrame, size: int, leaf: int, trees: int, seed: int) -> DataFrame:
    """(id, v, tree, cell): cells of at most ``leaf`` rows, cut at the median along random directions.

    Rows that no direction tells apart are dealt out by their hash. The levels work on the
    rows' places along the directions alone; vectors are joined to the cells at the end.
    """
    rows = cut_lineage(rows.select("id", "v", F.monotonically_increasing_id().alias("row")))
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    total = rows.count()
    if total <= leaf:
        return rows.select("id", "v", each, F.lit(0).cast("long").alias("cell"))
    ahead = max(1, math.ceil(math.log2(total / leaf))) + 1
    done, level = None, 0
    while True:
        if level % ahead == 0:  # the next directions
            at = rows.select("row", "id", "v", each).withColumn("cell", F.lit(0).cast("long")) if not level else work.drop("ps").join(rows.select("row", "v"), "row")
            planes = F.broadcast(_planes(rows.sparkSession, trees, size, range(level, level + ahead), seed))  # ``trees`` rows
            along = F.transform("planes", lambda plane: F.aggregate(F.zip_with("v", plane, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
            work = settle(at.join(planes, "tree").select("row", "id", "tree", "cell", along.alias("ps")))
        p = F.col("ps")[0]
        cuts = work.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(p, 0.5).alias("m"), F.min(p).alias("lo"), F.max(p).alias("hi"))
        cuts = settle(cuts)
        small = work.join(cuts.filter(F.col("n") <= leaf), ["tree", "cell"], "left_semi").select("row", "tree", "cell")
        done = small if done is None else done.unionByName(small)
        if cuts.filter(F.col("n") > leaf).isEmpty():
            return done.join(rows, "row").select("id", "v", "tree", "cell")
        above = F.when(F.col("lo") == F.col("hi"), F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 1)
        above = above.otherwise(F.when(F.col("m") == F.col("hi"), p >= F.col("m")).otherwise(p > F.col("m")))
        rest = F.slice("ps", 2, ahead).alias("ps")
        work = settle(work.join(cuts.filter(F.col("n") > leaf), ["tree", "cell"]).select("row", "id", "tree", F.xxhash64("cell", above).alias("cell"), rest))
        level += 1


def _near_in_leaf(k: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = np.stack(table.column("v").to_numpy()).astype(np.float64)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        near = min(k, len(ids) - 1)
        if not near:
            return schema.empty_table()
        centred = x - x.mean(axis=0)
        sq = (centred**2).sum(axis=1)
        look = min(near + 8, len(ids) - 1)  # rounding of the products may reorder the last ones
        out: list[list[np.ndarray]] = [[], [], []]
        for s in range(0, len(ids), 256):
            own = np.arange(s, min(s + 256, len(ids)))
            rough = sq[own, None] + sq - 2 * centred[own] @ centred.T
            rough[np.arange(len(own)), own] = np.inf
            to = np.sort(np.argpartition(rough, look - 1, axis=1)[:, :look], axis=1)
            d = np.sqrt(((x[to] - x[own, None]) ** 2).sum(axis=2))
            best = np.argsort(d, axis=1, kind="stable")[:, :near]
            out[0].append(np.repeat(ids[own], near))
            out[1].append(ids[np.take_along_axis(to, best, 1)].ravel())
            out[2].append(np.take_along_axis(d, best, 1).ravel())
        return pa.Table.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=schema)

    return run


def near_neighbours(rows: DataFrame, k: int, leaf: int = LEAF, trees: int = TREES, seed: int = 11) -> DataFrame:
    """a, b, d and place (from 1) of the ``k`` nearest rows found for every row (id, v); ties to the smaller id.

    With at most ``leaf`` rows they are the nearest ones. Vectors must be of one length.
    """
    first = rows.select(F.size("v").alias("s")).first()
    size = first["s"] if first else 1
    trees = 1 if rows.limit(leaf + 1).count() <= leaf else trees  # one leaf holds all
    found = _leaves(rows, size, leaf, trees, seed).groupBy("tree", "cell").applyInArrow(_near_in_leaf(k), "a long, b long, d double")
    found = found.repartition("a")  # both steps below need the rows of an ``a`` together
    order = Window.partitionBy("a").orderBy("d", "b")  # at most k rows of each tree
    return found.groupBy("a", "b").agg(F.min("d").alias("d")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def reachability_edges(rows: DataFrame, k: int = 8, min_samples: int = 2, leaf: int = LEAF, trees: int = TREES, seed: int = 11) -> DataFrame:
    """a < b and the distance w at which they reach each other, for neighbours and for equal vectors."""
    near = cut_lineage(near_neighbours(rows, max(k, min_samples), leaf, trees, seed))
    core = near.filter(F.col("place") == min_samples).select(F.col("a").alias("id"), F.col("d").alias("core"))
    twins = rows.join(rows.groupBy("v").agg(F.min("id").alias("a")), "v").filter("a <> id").select("a", F.col("id").alias("b"), F.lit(0.0).alias("d"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").unionByName(twins)
    pairs = pairs.groupBy("a", "b").agg(F.min("d").alias("d"))
    for end in "ab":
        pairs = pairs.join(core.select(F.col("id").alias(end), F.col("core").alias(f"core_{end}")), end, "left")
    # without ``min_samples`` others a row is dense nowhere
    return pairs.select("a", "b", F.greatest("d", *[F.coalesce(f"core_{e}", F.lit(float("inf"))) for e in "ab"]).alias("w"))


# What a chunk reads (states and edges) and writes, as rows of one shape.
ROWS = pa.schema([
    ("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("w", pa.float64()), ("total", pa.float64()), ("best", pa.float64()),
    ("size", pa.int64()), ("members", pa.list_(pa.int64())),
])
ROWS_DDL = "kind int, x long, y long, w double, total double, best double, size long, members array<long>"
EDGE, STATE, MERGED, CLUSTER, POINT = range(5)


class Merging:
    """Groups of rows, joined from the shortest edge on.

    A group is [size, its members while it is no cluster, its cluster, the sum over its rows
    of the density (1 / distance) at which they leave the cluster, stability of the best
    choice below it].
    """

    def __init__(self, least: int, first_name: int):
        self.least, self.name = least, first_name
        self.up: dict[int, int] = {}
        self.groups: dict[int, list] = {}
        self.out: list[tuple] = []

    def top(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = q = self.up.get(p, p)
            x = q
        return x

    def group(self, x: int) -> list:
        return self.groups.setdefault(x, [1, [x], None, 0.0, 0.0])

    def close(self, group: list, parent: int, w: float) -> float:
        """The group's cluster ends below a distance; the best stability in and below it."""
        stability = group[3] - group[0] / w
        self.out.append((CLUSTER, group[2], parent, w, stability, group[4], group[0], None))
        return max(stability, group[4])

    def join(self, a: int, b: int, w: float) -> None:
        a, b = sorted((self.top(a), self.top(b)))
        if a == b:
            return
        w = max(w, SHORTEST)
        g, h = self.group(a), self.group(b)
        size = g[0] + h[0]
        if g[2] is None and h[2] is None:
            new = [size, g[1] + h[1], None, 0.0, 0.0]
            if size >= self.least:
                self.out += [(POINT, p, self.name, None, None, None, None, None) for p in new[1]]
                new = [size, None, self.name, size / w, 0.0]
                self.name += 1
        elif g[2] is None or h[2] is None:
            large, small = (h, g) if g[2] is None else (g, h)
            self.out += [(POINT, p, large[2], None, None, None, None, None) for p in small[1]]
            new = [size, None, large[2], large[3] + small[0] / w, large[4]]
        else:
            best = self.close(g, self.name, w) + self.close(h, self.name, w)
            new = [size, None, self.name, size / w, best]
            self.name += 1
        self.up[b] = a
        del self.groups[b]
        self.groups[a] = new


def _walk(least: int, first_name: int):
    def run(table: pa.Table) -> pa.Table:
        m = Merging(least, first_name)
        rows = table.to_pylist()
        for r in rows:
            if r["kind"] == STATE:
                m.groups[r["x"]] = [r["size"], r["members"], r["y"], r["total"], r["best"]]
        for r in sorted((r for r in rows if r["kind"] == EDGE), key=lambda r: (r["w"], r["members"])):
            if r["w"] < float("inf"):
                m.join(r["x"], r["y"], r["w"])
        out = m.out
        out += [(MERGED, x, m.top(x), None, None, None, None, None) for x in m.up]
        out += [(STATE, x, g[2], None, g[3], g[4], g[0], g[1]) for x, g in m.groups.items() if g[0] > 1]
        columns = zip(*out) if out else [[] for _ in ROWS]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, ROWS.types)], schema=ROWS)

    return run


def condensed_clusters(edges: DataFrame, min_cluster_size: int = 2, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Clusters of the hierarchy over edges (a, b, w), and the cluster each row falls out of.

    Clusters: id, parent (null at the top), birth (the distance at which it joins its
    sibling; infinite at the top), stability, below (stability of the best choice below it),
    size. Rows: node, cluster. Edges of equal length are taken in the order of their ends.
    """
    spark = edges.sparkSession
    edges = settle(edges)
    total = edges.count()
    chunks = max(1, -(-total // chunk))
    if chunks > 1:
        edges = settle(edges.repartitionByRange(chunks, "w", "a", "b").withColumn("chunk", F.spark_partition_id()))
    else:
        edges = edges.withColumn("chunk", F.lit(0))
    states = spark.createDataFrame([], ROWS_DDL)
    roots = spark.createDataFrame([], "node long, root long")
    done = None
    for n in range(chunks):
        e = edges.filter(F.col("chunk") == n)
        if n:
            for end in "ab":
                e = e.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
        else:
            e = e.withColumns({"ra": F.col("a"), "rb": F.col("b")})
        e = e.filter("ra <> rb")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("total", "double"), ("best", "double"), ("size", "long"))]
        asks = e.select(F.lit(EDGE).alias("kind"), F.col("ra").alias("x"), F.col("rb").alias("y"), "w", *none, F.array("a", "b").alias("members"))
        asks = settle(asks)
        touched = asks.select(F.explode(F.array("x", "y")).alias("x")).distinct()
        given = states.join(touched, "x", "left_semi").select(*ROWS.names)
        both = asks.unionByName(given).withColumn("chunk", F.lit(n))  # at most a chunk of edges, and the groups at their ends
        got = both.groupBy("chunk").applyInArrow(_walk(min_cluster_size, n << 40), ROWS_DDL)
        got = settle(got)
        done = got if done is None else done.unionByName(got)
        if n + 1 < chunks:
            merged = got.filter(F.col("kind") == MERGED).select(F.col("x").alias("root"), F.col("y").alias("to"))
            moved = roots.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = settle(moved.unionByName(merged.select(F.col("root").alias("node"), F.col("to").alias("root"))))
        states = settle(states.join(touched, "x", "left_anti").select(*ROWS.names).unionByName(got.filter(F.col("kind") == STATE)))
    points = done.filter(F.col("kind") == POINT).select(F.col("x").alias("node"), F.col("y").alias("cluster"))
    inner = done.filter(F.col("kind") == CLUSTER).select(F.col("x").alias("id"), F.col("y").alias("parent"), F.col("w").alias("birth"), F.col("total").alias("stability"), F.col("best").alias("below"), "size")
    tops = states.filter("y IS NOT NULL").select(F.col("y").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(float("inf")).alias("birth"), F.col("total").alias("stability"), F.col("best").alias("below"), "size")
    return inner.unionByName(tops), points


def _topmost(tree: DataFrame, marked: str) -> DataFrame:
    """id and top: the marked cluster nearest to the top on the way from each cluster upwards, itself included."""
    way = settle(tree.select("id", F.col("parent").alias("up"), F.when(F.col(marked), F.col("id")).alias("top")))
    while not way.filter("up IS NOT NULL").isEmpty():
        above = way.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("top").alias("higher"))
        way = settle(way.join(above, "up", "left").select("id", F.col("further").alias("up"), F.coalesce("higher", "top").alias("top")))
    return way.select("id", "top")


def selected_clusters(clusters: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """id and top: the selected cluster that each cluster belongs to, null if none.

    The most stable choice is taken, of equal ones the upper; a top that stands alone is the
    whole table and no cluster. Selected clusters born below ``epsilon`` give way to the first
    cluster above them that isn't.
    """
    clusters = settle(clusters)
    alone = clusters.filter("parent IS NULL").count() == 1
    whole = F.col("parent").isNull() if alone else F.lit(False)
    tree = clusters.withColumn("chosen", (F.col("stability") >= F.col("below")) & ~whole)
    tops = _topmost(tree, "chosen")
    if epsilon <= 0:
        return tops
    above = tree.select(F.col("id").alias("parent"), whole.alias("last"))
    steps = tree.join(above, "parent", "left")
    rises = (F.col("birth") < epsilon) & F.col("parent").isNotNull() & ~F.coalesce("last", F.lit(True))
    ways = settle(steps.select("id", F.when(rises, F.col("parent")).otherwise(F.col("id")).alias("to")))
    while True:
        further = ways.select(F.col("id").alias("to"), F.col("to").alias("then"))
        stepped = settle(ways.join(further, "to").select("id", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("went")))
        ways = stepped.select("id", "to")
        if stepped.filter("went").isEmpty():
            break
    kept = tops.filter("top IS NOT NULL").select(F.col("top").alias("id")).distinct().join(ways, "id").select(F.col("to").alias("id"), F.lit(True).alias("kept")).distinct()
    return _topmost(tree.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False))), "kept")


def density_clusters(
    df: DataFrame, ident: str, vec: str, k: int = 8, min_samples: int = 2, min_cluster_size: int = 2, epsilon: float = 0.2,
    out: str = "similar", leaf: int = LEAF, trees: int = TREES, chunk: int = CHUNK, seed: int = 11,
) -> DataFrame:
    """Rows with the density cluster of their vector, named by its smallest id; -1 is noise.

    ``ident`` is unique and a whole number. Rows without a vector are noise. Parts that no
    neighbours join are as far apart as can be.
    """
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.transform(F.col(vec), lambda e: e.cast("double")).alias("v"))
    rows = cut_lineage(rows)
    clusters, points = condensed_clusters(reachability_edges(rows, k, min_samples, leaf, trees, seed), min_cluster_size, chunk)
    tops = selected_clusters(clusters, epsilon)
    placed = points.join(tops.filter("top IS NOT NULL"), points["cluster"] == tops["id"]).select("node", "top")
    named = placed.groupBy("top").agg(F.min("node").alias("__name"))
    labels = placed.join(named, "top").select(F.col("node").alias("__node"), "__name")
    joined = df.join(labels, F.col(ident).cast("long") == F.col("__node"), "left")
    return joined.withColumn(out, F.coalesce("__name", F.lit(-1).cast("long"))).drop("__node", "__name")
