"""Connected components, groups of vectors, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core.hashing import seeded_hash
from surveyspark.core.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of the component for every node that has an edge: node, component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step is a
    grouped minimum and an equality join, and no node's neighbours are ever collected.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    state = None
    while True:
        # large star: neighbours above a node move to the smallest node around it
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.*").filter("u <> v").distinct()
        )
        e = cut_lineage(small)
        new_state = e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if new_state == state:
            break
        state = new_state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def standardise_vectors(df: DataFrame, vec: str, size: int) -> DataFrame:
    """Every component standardised over all rows (population deviation)."""
    stats = df.agg(
        F.struct(
            F.array(*[F.avg(F.col(vec)[i]) for i in range(size)]).alias("m"),
            F.array(*[F.stddev_pop(F.col(vec)[i]) for i in range(size)]).alias("s"),
        ).alias("ms")
    )
    zipped = F.arrays_zip(F.col(vec).alias("v"), F.col("__ms.m").alias("m"), F.col("__ms.s").alias("s"))
    scaled = F.transform(
        zipped, lambda t: (t["v"].cast("double") - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(1.0)
    )
    return df.withColumn("__ms", stats.scalar()).withColumn(vec, scaled).drop("__ms")


def kmeans_labels(df: DataFrame, vec: str, size: int, k: int = 3, seed: int = 0, out: str = "cluster") -> DataFrame:
    """k-means on standardised vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = standardise_vectors(df, vec, size).withColumn("__features", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol=out).fit(data)
    return model.transform(data).drop("__features")


#: Bytes of the vectors of a block, and blocks that a cell is cut into for the sake of parallel work.
BLOCK_BYTES, BLOCKS = 1 << 24, 16


def vector_near_pairs(
    df: DataFrame, ident: str, vec: str, radius: float, pivots: int = 64, max_cell: int = 2048, depth: int = 8, seed: int = 7
) -> DataFrame:
    """Edges of the graph that joins vectors at most ``radius`` apart, enough to find its components.

    Equal vectors are reduced to one. Vectors are put into the cell of their nearest pivot; by
    the triangle inequality a vector must also be seen by every cell whose pivot is no more
    than ``2 · radius`` farther. Cells above ``max_cell`` vectors are divided again with pivots
    of their own, up to ``depth`` times, but only where the copies are worth it: where they at
    least halve the pairs to compare and send no more rows for that. Else most vectors lie in
    most cells, and the cell is compared as it is, in blocks of bounded size; pairs of blocks
    go to different tasks.
    """
    rows = df.select(F.col(ident).alias("a"), F.col(vec).alias("v")).filter("a IS NOT NULL AND v IS NOT NULL")
    distinct = cut_lineage(rows.groupBy("v").agg(F.min("a").alias("id"), F.count(F.lit(1)).alias("n")))
    twins = rows.join(distinct.filter("n > 1"), "v").filter("a <> id").select("a", F.col("id").alias("b"))
    first = distinct.select(F.size("v").alias("s")).first()
    block = max(max_cell, BLOCK_BYTES // (8 * max(first["s"], 1) if first else 8))
    work = distinct.select("id", "v", F.lit("0").alias("cell"))
    cells = None
    for level in range(depth + 1):
        sizes = cut_lineage(work.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        big = sizes.filter(F.col("n") > max_cell)
        gain = None
        if level < depth and not big.isEmpty():
            counts, divided = _divide(work, big, radius, pivots, max_cell, block, f"{seed}-{level}")
            m, n = F.col("m"), F.col("n")
            after = [F.sum(m.cast("double") * m).alias("pairs"), F.sum(m * _blocks(m, max_cell, block)).alias("sent")]
            gain = counts.groupBy("cell", "c").agg(F.sum("m").alias("m")).groupBy("cell").agg(*after).join(big, "cell")
            worth = (F.col("pairs") * 2 <= n.cast("double") * n) & (F.col("sent") <= n * _blocks(n, max_cell, block))
            gain = cut_lineage(gain.filter(worth).select("cell"))
        done = work.join(sizes, "cell")
        if gain is None or gain.isEmpty():
            cells = done if cells is None else cells.unionByName(done)
            break
        done = cut_lineage(done.join(gain, "cell", "left_anti"))
        cells = done if cells is None else cells.unionByName(done)
        work = cut_lineage(divided(gain))
    return _block_edges(cells, max_cell, block, radius).unionByName(twins)


def _blocks(n: Column, max_cell: int, block: int) -> Column:
    """Into how many blocks a cell of ``n`` vectors is cut: some for parallel work, more as they would outgrow ``block``."""
    return F.greatest(F.ceil(n / block), F.least(F.ceil(n / max_cell), F.lit(BLOCKS).cast("bigint")))


def _divide(work: DataFrame, big: DataFrame, radius: float, pivots: int, max_cell: int, block: int, seed: str):
    """How many copies (cell, c, m) the ``big`` cells would send to each of their pivots, and a function that makes them.

    Cells are read in slices of bounded size, each next to its pivots.
    """
    rows = work.join(big, "cell").withColumn("h", seeded_hash(seed, "id"))
    chosen = rows.groupBy("cell", "n", F.pmod("h", F.lit(pivots)).alias("c")).agg(F.min_by("v", "h").alias("p"))
    slices = _blocks(F.col("n"), max_cell, block)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("id"), slices)).select("cell", "slice", "id", "v")
    beside = chosen.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))).select(F.col("cell").alias("cell"), "slice", "c", "p")
    ident = work.schema["id"].dataType.simpleString()
    vector = work.schema["v"].dataType.simpleString()

    def counts(left: pa.Table, right: pa.Table) -> pa.Table:
        cell, got = _near_pivots(left, right, radius)
        return pa.table({"cell": [cell] * len(got), "c": pa.array([c for c, _ in got], pa.int64()), "m": pa.array([len(at) for _, at in got], pa.int64())})

    def copies(left: pa.Table, right: pa.Table) -> pa.Table:
        cell, got = _near_pivots(left, right, radius)
        parts = [left.take(at).select(["id", "v"]).append_column("cell", pa.array([f"{cell}.{c}"] * len(at), pa.string())) for c, at in got]
        return pa.concat_tables(parts) if parts else left.slice(0, 0).select(["id", "v", "cell"])

    def run(mine: DataFrame, its: DataFrame, how, schema: str) -> DataFrame:
        return mine.groupBy("cell", "slice").cogroup(its.groupBy("cell", "slice")).applyInArrow(how, schema)

    def divided(cells: DataFrame) -> DataFrame:
        mine, its = (d.join(cells, "cell", "left_semi") for d in (dealt, beside))
        return run(mine, its, copies, f"id {ident}, v {vector}, cell string")

    return run(dealt, beside, counts, "cell string, c long, m long"), divided


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column; a missing component is not a number."""
    return np.stack(column.to_numpy())


def _near_pivots(left: pa.Table, right: pa.Table, radius: float) -> tuple[str, list[tuple[int, pa.Array]]]:
    """The cell, and for each pivot the rows for whom it is the nearest or almost as near."""
    if not len(left) or not len(right):
        return "", []
    x, p = _matrix(left.column("v")), _matrix(right.column("p")).astype(np.float64)
    d = np.empty((len(x), len(p)))
    for s in range(0, len(x), 4096):
        part = x[s : s + 4096].astype(np.float64)
        for k in range(len(p)):
            d[s : s + 4096, k] = np.sqrt(((part - p[k]) ** 2).sum(axis=1))
    near = d <= d.min(axis=1, keepdims=True) * (1 + 1e-12) + 2 * radius * (1 + 1e-9)
    return left.column("cell")[0].as_py(), [(c, pa.array(np.flatnonzero(near[:, k]))) for k, c in enumerate(right.column("c").to_pylist()) if near[:, k].any()]


class _Links:
    """Components of numbered vectors; what joins two of them is kept as an edge."""

    def __init__(self, label: np.ndarray):
        self.label, self.edges = label.astype(np.int64), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Edges between the vectors at ``a`` and those at ``b``, where they join two components."""
        up: dict[int, int] = {}

        def top(i: int) -> int:
            while (p := up.get(i, i)) != i:
                up[i] = i = up.get(p, p)
            return i

        for i, j in zip(a.tolist(), b.tolist()):
            r, t = top(int(self.label[i])), top(int(self.label[j]))
            if r != t:
                up[max(r, t)] = min(r, t)
                self.edges.append((i, j))
        if up:
            to = np.arange(len(self.label))
            for i in up:
                to[i] = top(i)
            self.label = to[self.label]


def _link(x: np.ndarray, links: _Links, rows: range, others: range, radius: float) -> None:
    """Joins the components of all vectors of ``rows`` and ``others`` (the same, or two parts) at most ``radius`` apart.

    A product of matrices leaves out pairs that are farther apart by more than its rounding;
    the distance of the rest is taken from the differences of their components.
    """
    most = radius * radius * (1 + 1e-12)
    whole = np.flatnonzero(np.isfinite(x).all(axis=1))  # others are near to none
    if len(whole) < 2:
        return
    near = x[whole].astype(np.float64)
    near -= near.mean(axis=0)
    sq = (near * near).sum(axis=1)
    single = np.median(sq) * 1e-4 < most and sq.max() < 1e30  # else single precision would leave out little
    kind, slack = (np.float32, 2.0**-22) if single else (np.float64, 2.0**-51)
    # with h = (|a|^2 - most / 2) / 2, and somewhat less for the rounding, near pairs have a·b - h(a) - h(b) >= 0
    h = (sq * (1 - (x.shape[1] + 32) * slack) - most / 2) / 2
    here = np.column_stack([near, -h, np.ones(len(h))]).astype(kind)
    there = np.column_stack([near, np.ones(len(h)), -h]).astype(kind)
    del near
    first, last = (whole[(whole >= r.start) & (whole < r.stop)] for r in (rows, others))
    at = np.zeros(len(x), dtype=np.int64)
    at[whole] = np.arange(len(whole))
    for s in range(0, len(first), 512):
        own = first[s : s + 512]
        mine = here[at[own]]
        to = last if rows != others else last[: s + 512]
        for t in range(0, len(to), 1024):
            other = to[t : t + 1024]
            if (links.label[own] == links.label[own[0]]).all() and (links.label[other] == links.label[own[0]]).all():
                continue
            rough = mine @ there[at[other[0]] : at[other[-1]] + 1].T
            if rough.max() < 0:
                continue
            i, j = np.nonzero(rough >= 0)
            a, b = own[i], other[j]
            while True:
                open_ = links.label[a] != links.label[b]
                a, b = a[open_], b[open_]
                if not len(a):
                    break
                some = np.arange(len(a)) % (len(a) // 8192 + 1) == 0  # from all rows: what they join drops out above
                i, j, a, b = a[some], b[some], a[~some], b[~some]
                d = ((x[i].astype(np.float64) - x[j]) ** 2).sum(axis=1)
                links.join(i[d <= most], j[d <= most])


def _packed(radius: float):
    """One row for a block: its ids in order, the components that its own vectors form, the vectors as bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _matrix(table.column("v"))
        x = np.ascontiguousarray(x if x.dtype == np.float32 else x.astype(np.float64))
        links = _Links(np.arange(len(x)))
        _link(x, links, range(len(x)), range(len(x)), radius)
        ids = table.column("id").combine_chunks()
        return pa.table({
            "cell": table.column("cell")[:1], "own": table.column("own")[:1], "blocks": table.column("blocks")[:1],
            "ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids),
            "label": pa.array([links.label.astype("<i4").tobytes()], pa.binary()),
            "size": pa.array([x.shape[1]], pa.int32()), "bytes": pa.array([x.dtype.itemsize], pa.int32()), "v": pa.array([x.tobytes()], pa.binary()),
        })

    return run


def _meet(radius: float):
    """Edges between the components of two blocks; a block alone gives those of its own."""

    def run(table: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([c.values for c in (table.column("ids")[k] for k in range(len(table)))])
        label = [np.frombuffer(table.column("label")[k].as_py(), "<i4").astype(np.int64) for k in range(len(table))]
        if len(table) == 1:
            a, b = np.arange(len(label[0])), label[0]
            a, b = a[a != b], b[a != b]
        else:
            n = len(label[0])
            links = _Links(np.concatenate([label[0], label[1] + n]))
            x = np.concatenate([
                np.frombuffer(table.column("v")[k].as_buffer(), f"<f{table.column('bytes')[k].as_py()}").reshape(len(label[k]), table.column("size")[k].as_py())
                for k in range(2)
            ])
            _link(x, links, range(n), range(n, len(x)), radius)
            a, b = np.array(links.edges, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    return run


def _block_edges(cells: DataFrame, max_cell: int, block: int, radius: float) -> DataFrame:
    """Near pairs inside each cell (id, v, cell, n), thinned to a forest with the same components.

    A cell is dealt out over blocks; a block is packed into one row, with the components
    inside it, and every pair of blocks is one group.
    """
    blocks = _blocks(F.col("n"), max_cell, block)
    ident = cells.schema["id"].dataType.simpleString()
    dealt = cells.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "v", "cell", "own", "blocks")
    packed = cut_lineage(
        dealt.groupBy("cell", "own").applyInArrow(
            _packed(radius), f"cell string, own long, blocks long, ids array<{ident}>, label binary, size int, bytes int, v binary"
        )
    )
    pairs = packed.agg(F.sum((F.col("blocks") + 1) / 2)).first()[0] or 1
    paired = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    paired = paired.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other", "blocks")
    parts = max(1, min(int(pairs), 4096))  # each pair is much work and few bytes
    return paired.repartition(parts, "cell", "p", "q").groupBy("cell", "p", "q").applyInArrow(_meet(radius), f"a {ident}, b {ident}")


def cluster_vectors(df: DataFrame, ident: str, vec: str, radius: float, out: str = "similar") -> DataFrame:
    """Groups of vectors linked by steps of at most ``radius``; the label is the smallest id, lone vectors get -1."""
    comps = connected_components(vector_near_pairs(df, ident, vec, radius))
    comps = comps.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return df.join(comps, F.col(ident) == F.col("__node"), "left").withColumn(
        out, F.coalesce("__component", F.lit(-1))
    ).drop("__node", "__component")
