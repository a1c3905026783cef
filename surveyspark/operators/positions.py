"""Single-linkage clusters of positions, for many radii in one pass.

Every radius has a grid of its own on the globe, with cells so small that points of one cell
are linked whatever they are. What is left to know is which cells hold two points that are
near enough. Cells that could are found by eight shifted grids of twice the radius: two near
points share a cell of at least one of them. A pair of cells is decided by its boxes: each
cell is cut into up to 64 boxes, near corners or representatives settle most pairs at once,
and only box pairs that could go either way are cut again. A crowded cell is so settled by
its boxes and never by its point pairs.

All radii go through the same plan, the radius being a part of the cell's name: fifteen radii
take as many jobs as one. Points without a neighbour at the largest radius are noise at every
radius and leave at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core.hashing import HASH_SPAN, seeded_hash
from surveyspark.core.ordering import hash_positions
from surveyspark.core.session import cut_lineage
from surveyspark.functions.geo import chord_of_km, unit_vector
from surveyspark.operators.clustering import connected_components
from surveyspark.operators.joins import category_rank

_XYZ = ("x", "y", "z")
#: Edges of one radius that one task may join; more go through rounds over the whole cluster.
TASK_EDGES = 500_000
#: Each step cuts a box in so many parts per side.
PARTS = 4


def _cell(side: Column, *names: Column | str) -> Column:
    return F.struct(F.col("level"), *[F.floor(F.col(c) / side).cast("bigint").alias(n) for c, n in zip(_XYZ, "ijk")])


def _shared_keys(placed: DataFrame, *keep: str) -> DataFrame:
    """Key in each of the eight shifted grids, and the columns to keep, of every point."""
    reach = F.col("eps") * (2 * (1 + 1e-9))
    shifts = F.array(*[F.struct(*[F.lit(d * 0.5).alias(c) for d, c in zip((n & 1, n >> 1 & 1, n >> 2), _XYZ)], F.lit(n).alias("n")) for n in range(8)])
    keys = placed.withColumn("s", F.explode(shifts))
    name = F.struct("level", "s.n", *[F.floor(F.col(c) / reach + F.col(f"s.{c}")).cast("bigint").alias(k) for c, k in zip(_XYZ, "pqr")])
    return keys.select(name.alias("key"), *keep)


def _candidate_cells(placed: DataFrame) -> DataFrame:
    """Pairs of cells (a, b) of one level that are at most two cells apart in each direction and share a shifted cell.

    A shifted cell holds at most five cells in each direction, so its list is short.
    """
    lists = _shared_keys(placed, "cell").distinct().groupBy("key").agg(F.sort_array(F.collect_list("cell")).alias("cells")).filter(F.size("cells") > 1)
    near = " AND ".join(f"abs(b.{d} - a.{d}) <= 2" for d in "ijk")
    pairs = f"flatten(transform(cells, (a, n) -> transform(filter(slice(cells, n + 2, size(cells)), b -> {near}), b -> struct(a AS a, b AS b))))"
    return lists.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b").distinct()


def _boxes(placed: DataFrame, depth: int) -> DataFrame:
    """For every box of depth ``depth`` (0: the cell): its parts, with corners and one point of each."""
    side = F.col("side")
    part = placed.groupBy("cell", "eps", _cell(side / PARTS**depth).alias("box"), _cell(side / PARTS ** (depth + 1)).alias("part")).agg(
        F.struct(*[F.min(c).alias(c) for c in _XYZ]).alias("lo"), F.struct(*[F.max(c).alias(c) for c in _XYZ]).alias("hi"),
        F.min(F.struct(*_XYZ)).alias("rep"),
    )
    return part.groupBy("cell", "box").agg(F.first("eps").alias("eps"), F.collect_list(F.struct("part", "lo", "hi", "rep")).alias("parts"))


def _d2(p: Column, r: Column) -> Column:
    return sum((F.pow(p[c] - r[c], 2) for c in _XYZ), F.lit(0.0))


def _gap2(p: Column, r: Column) -> Column:
    gaps = [F.greatest(p["lo"][c] - r["hi"][c], r["lo"][c] - p["hi"][c], F.lit(0.0)) for c in _XYZ]
    return sum((g * g for g in gaps), F.lit(0.0))


def _decide(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(a, b, near, open) of pairs of boxes (a, b, a_box, b_box): ``open`` lists the pairs of parts that could go either way."""
    sides = [boxes.select(F.col("cell").alias(t), F.col("box").alias(f"{t}_box"), F.col("parts").alias(f"{t}_parts"), F.col("eps").alias(f"{t}_eps")) for t in "ab"]
    met = pairs.join(sides[0], ["a", "a_box"]).join(sides[1], ["b", "b_box"])
    e2 = F.col("a_eps") * F.col("a_eps")
    near = F.exists("a_parts", lambda p: F.exists("b_parts", lambda r: _d2(p["rep"], r["rep"]) <= e2))

    def open_with(p: Column) -> Column:
        def may(r: Column) -> Column:
            points = (_d2(p["lo"], p["hi"]) == 0) & (_d2(r["lo"], r["hi"]) == 0)
            return (_gap2(p, r) <= e2) & ~points

        return F.transform(F.filter("b_parts", may), lambda r: F.struct(p["part"].alias("a_box"), r["part"].alias("b_box")))

    undecided = F.when(~F.col("near"), F.flatten(F.transform("a_parts", open_with)))
    return met.withColumn("near", near).select("a", "b", "near", undecided.alias("open"))


def near_cells(placed: DataFrame, depth: int = 15) -> DataFrame:
    """Pairs of cells (a, b) that hold two points at most ``eps`` apart.

    ``placed``: distinct x, y, z with level, eps, side and cell. Boxes still open after
    ``depth`` steps are smaller than a rounding error of positions; their points are compared.
    """
    pairs = _candidate_cells(placed).select("a", "b", F.col("a").alias("a_box"), F.col("b").alias("b_box"))
    found = None
    for step in range(depth):
        met = cut_lineage(_decide(pairs, _boxes(placed, step)))
        near = met.filter("near").select("a", "b").distinct()
        found = near if found is None else found.unionByName(near)
        rest = met.filter("NOT near AND size(open) > 0")
        if rest.isEmpty():
            return found.distinct()
        pairs = rest.join(near, ["a", "b"], "left_anti").select("a", "b", F.explode("open").alias("o")).select("a", "b", "o.*")
    at = placed.select("cell", "eps", _cell(F.col("side") / PARTS**depth).alias("box"), F.struct(*_XYZ).alias("at"))
    sides = [at.select(F.col("cell").alias(t), F.col("box").alias(f"{t}_box"), F.col("at").alias(f"{t}_at"), F.col("eps").alias(f"{t}_eps")) for t in "ab"]
    met = pairs.join(sides[0], ["a", "a_box"]).join(sides[1], ["b", "b_box"])
    last = met.filter(_d2(F.col("a_at"), F.col("b_at")) <= F.col("a_eps") * F.col("a_eps")).select("a", "b")
    return found.unionByName(last).distinct()


def smallest_labels(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Smallest node of the component of every node, by hooking and pointer jumping."""
    label = np.arange(nodes)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (label[label] != label).any():
            label = label[label]


def _join_in_task(table: pa.Table) -> pa.Table:
    """Roots of the cells of one level."""
    ends = [np.stack([table.column(f"{t}_{c}").to_numpy() for c in "ijk"], axis=1) for t in "ab"]
    names, to = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
    to = to.reshape(-1)
    root = names[smallest_labels(to[: table.num_rows], to[table.num_rows :], len(names))]
    level = pa.array(np.full(len(names), table.column("level")[0].as_py(), np.int32))
    return pa.table([level, *[pa.array(x[:, n]) for x in (names, root) for n in range(3)]], names=["level", "i", "j", "k", "ri", "rj", "rk"])


def cell_roots(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Smallest cell of its component (node, component) for every cell with an edge (a, b), each level for itself."""
    edges = cut_lineage(edges)
    most = edges.groupBy("a.level").count().agg(F.max("count").alias("m")).first()["m"] or 0
    if most > task_edges:
        return connected_components(edges)
    flat = edges.select("a.level", *[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in "ijk"])
    out = flat.groupBy("level").applyInArrow(_join_in_task, "level int, i long, j long, k long, ri long, rj long, rk long")
    return out.select(F.struct("level", "i", "j", "k").alias("node"), F.struct("level", F.col("ri").alias("i"), F.col("rj").alias("j"), F.col("rk").alias("k")).alias("component"))


def _levels(radii_km: Sequence[float]) -> list[Column]:
    eps = [chord_of_km(km) for km in radii_km]
    return [F.struct(F.lit(n).alias("level"), F.lit(e).alias("eps"), F.lit(e / 3**0.5 * (1 - 1e-12)).alias("side")) for n, e in enumerate(eps)]


def linked_cells(points: DataFrame, radii_km: Sequence[float], task_edges: int = TASK_EDGES) -> DataFrame:
    """cell (level, i, j, k) and root of every cell that belongs to a cluster of at least two points.

    ``points``: x, y, z and n rows at that place. ``level`` is the place of the radius in ``radii_km``.
    """
    levels = _levels(radii_km)
    widest = int(np.argmax(radii_km))

    def on(rows: DataFrame, chosen: Sequence[Column]) -> DataFrame:
        return rows.withColumn("l", F.explode(F.array(*chosen))).select(*_XYZ, "n", "l.*").withColumn("cell", _cell(F.col("side")))

    if len(levels) > 1:  # who has no neighbour at the widest radius has none at all
        keys = _shared_keys(on(points, [levels[widest]]), *_XYZ, "n")
        full = keys.groupBy("key").agg(F.sum("n").alias("m")).filter("m > 1").select("key")
        points = cut_lineage(keys.join(full, "key", "left_semi").select(*_XYZ, "n").distinct())
    placed = on(points, levels)
    roots = cell_roots(near_cells(placed), task_edges).select(F.col("node").alias("cell"), F.col("component").alias("root"))
    crowded = placed.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell")
    own = crowded.join(roots, "cell", "full")
    return own.select("cell", F.coalesce("root", "cell").alias("root"))


def _places(df: DataFrame, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a position, with x, y, z; and the distinct places with their number of rows."""
    xyz = dict(zip(_XYZ, unit_vector(F.col("la").cast("double"), F.col("lo").cast("double"))))
    known = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    points = known.groupBy(F.col(lat).alias("la"), F.col(lon).alias("lo")).agg(F.count(F.lit(1)).alias("n")).withColumns(xyz)
    points = cut_lineage(points.groupBy(*_XYZ).agg(F.sum("n").alias("n")))
    return known.withColumns(dict(zip(["__x", "__y", "__z"], unit_vector(F.col(lat).cast("double"), F.col(lon).cast("double"))))), points


def cells_of(levels: Sequence[Column], cols: Sequence[str]) -> Column:
    """The cell of a row (unit vector in ``cols``) at every level."""
    return F.array(*[F.struct(lv["level"].alias("level"), *[F.floor(F.col(c) / lv["side"]).cast("bigint").alias(n) for c, n in zip(cols, "ijk")]) for lv in levels])


def position_levels(
    df: DataFrame, radii_km: Sequence[float], lat: str = "LATNUM", lon: str = "LONGNUM", task_edges: int = TASK_EDGES, out: str = "clustered"
) -> DataFrame:
    """Rows repeated for every radius: ``distance`` and the cluster they belong to there, null for noise.

    Clusters are the connected components of the rows at most ``distance`` kilometres apart,
    so those of a radius lie inside those of any larger one. The cluster is named by one of its
    cells, which says nothing but that equal names are one cluster. Rows without a position
    are left out.
    """
    rows, points = _places(df, lat, lon)
    cells = linked_cells(points, radii_km, task_edges)
    distance = F.element_at(F.array(*[F.lit(float(km)) for km in radii_km]), F.col("__cell.level") + 1)
    long = rows.withColumn("__cell", F.explode(cells_of(_levels(radii_km), ["__x", "__y", "__z"]))).drop("__x", "__y", "__z")
    named = cells.select(F.col("cell").alias("__cell"), F.col("root").alias(out))
    return long.join(named, "__cell", "left").withColumn("distance", distance).drop("__cell")


def cluster_positions(
    df: DataFrame, ident: Sequence[str], eps_km: float, lat: str = "LATNUM", lon: str = "LONGNUM",
    noise: str | None = None, noise_group: int = 30, seed: int = 42, out: str = "clustered", task_edges: int = TASK_EDGES,
) -> DataFrame:
    """Density clusters of positions with at least two points within ``eps_km`` of each other.

    With two as the minimum every point that has a neighbour is a core point, so clusters
    are the connected components of the neighbour graph, numbered from 0; noise is -1.
    ``noise="unique"`` adds a column with -1, -2, … for noise points, ``noise="grouped"``
    one with the same label for ``noise_group`` of them.
    """
    rows, points = _places(df, lat, lon)
    cells = cut_lineage(linked_cells(points, [eps_km], task_edges))
    labels = category_rank(cells.select("root").distinct(), "root", [F.col("root").asc()], "__label")
    named = cells.join(labels, "root").select(F.col("cell").alias("__cell"), "__label")
    own = rows.withColumn("__cell", cells_of(_levels([eps_km]), ["__x", "__y", "__z"])[0]).drop("__x", "__y", "__z")
    result = own.join(named, "__cell", "left").withColumn(out, F.coalesce("__label", F.lit(-1))).drop("__cell", "__label")
    if noise is None:
        return result
    lone = result.filter(F.col(out) == -1).select(*ident).withColumn("__h", seeded_hash(seed, *ident))
    pos = hash_positions(lone, "__h", HASH_SPAN, ties=ident)
    step = F.col("position") if noise == "unique" else F.floor(F.col("position") / noise_group)
    name = f"{out}: {'unique' if noise == 'unique' else 'grouped'} non-clustered"
    pos = pos.select(*ident, (-1 - step).cast("bigint").alias("__noise"))
    return result.join(pos, list(ident), "left").withColumn(name, F.coalesce("__noise", out)).drop("__noise")
