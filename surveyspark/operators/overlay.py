"""Exact overlay of two polygon layers.

Both layers are cut along the lines of one grid. What a polygon has in a cell is a short list
of pieces, running from left to right: its edges inside the cell, and those stretches of the
cell's upper side that lie inside it. Seen from above, every second piece at a place begins
or ends the polygon (the even-odd rule, so holes and islands need no order), and an odd one
reaches down to the cell's floor. Cells of the two layers meet by equality. Between two
neighbouring ends or crossings of pieces the shared height is a linear function of x, so
its middle times the width is its exact area. No vertex list of a whole polygon meets
another: work goes by edges and cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges that a cell should hold on average.
EDGES_PER_CELL = 4


def polygon_edges(polygons: DataFrame, ident: str, rings: str) -> DataFrame:
    """ident, xa, ya, xb, yb of every edge; the last point of a ring joins the first."""
    following = F.concat(F.slice("__pts", 2, F.greatest(F.size("__pts") - 1, F.lit(0))), F.slice("__pts", 1, 1))
    edge = F.zip_with("__pts", following, lambda a, b: F.struct(a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"), b["y"].alias("yb")))
    return polygons.select(ident, F.explode(rings).alias("__pts")).filter(F.size("__pts") > 2).select(ident, F.explode(edge).alias("e")).select(ident, "e.*")


def _lines(low: Column, high: Column) -> Column:
    """Numbers from ``low`` to ``high``, none if these are in the wrong order."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _number(x: Column, tile: float) -> Column:
    return F.floor(x / F.lit(tile)).cast("bigint")


def clipped_edges(edges: DataFrame, ident: str, tile: float) -> DataFrame:
    """ident, col, row, xl, yl, xr, yr: edges from left to right, cut at all grid lines. Upright ones bound no area."""
    turned = F.col("xa") > F.col("xb")
    e = edges.filter("xa <> xb").select(
        ident, *[F.when(turned, F.col(f"{c}b")).otherwise(F.col(f"{c}a")).alias(f"{c}0") for c in "xy"],
        *[F.when(turned, F.col(f"{c}a")).otherwise(F.col(f"{c}b")).alias(f"{c}1") for c in "xy"],
    )
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    upright = F.transform(_lines(_number(x0, tile) + 1, _number(x1, tile)), lambda k: k * F.lit(tile))
    level = F.transform(_lines(_number(low, tile) + 1, _number(high, tile)), lambda k: x0 + (k * F.lit(tile) - y0) * (x1 - x0) / (y1 - y0))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(x0, x1), F.filter(F.concat(upright, level), lambda x: (x > x0) & (x < x1)))))
    e = e.withColumn("__cuts", cuts)

    def at(x: Column) -> Column:
        return F.when(x == x1, y1).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))

    pieces = F.zip_with(F.slice("__cuts", 1, F.size("__cuts") - 1), F.slice("__cuts", 2, F.size("__cuts") - 1), lambda p, q: F.struct(p.alias("xl"), at(p).alias("yl"), q.alias("xr"), at(q).alias("yr")))
    out = e.select(ident, F.explode(pieces).alias("p")).select(ident, "p.*")
    return out.select(ident, _number((F.col("xl") + F.col("xr")) / 2, tile).alias("col"), _number((F.col("yl") + F.col("yr")) / 2, tile).alias("row"), "xl", "yl", "xr", "yr")


def covered_tops(edges: DataFrame, ident: str, tile: float) -> DataFrame:
    """The same columns for the stretches of upper sides of cells that lie inside a polygon."""
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    # just below a line: edges that begin on it don't cross, edges that end on it do
    lines = edges.withColumn("__j", F.explode(_lines(_number(low, tile) + 1, _number(high, tile))))
    y = F.col("__j") * F.lit(tile)
    x = F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    met = lines.groupBy(ident, "__j").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    inside = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("a"), F.get("xs", i + 1).alias("b")))
    long = met.filter(F.size("xs") > 1).select(ident, "__j", F.explode(inside).alias("i")).filter("i.b > i.a")
    cols = _lines(_number(F.col("i.a"), tile), F.ceil(F.col("i.b") / F.lit(tile)).cast("bigint") - 1)
    cut = long.withColumn("col", F.explode(cols))
    left, right = F.greatest(F.col("i.a"), F.col("col") * F.lit(tile)), F.least(F.col("i.b"), (F.col("col") + 1) * F.lit(tile))
    out = cut.select(ident, "col", (F.col("__j") - 1).alias("row"), left.alias("xl"), y.alias("yl"), right.alias("xr"), y.alias("yr"))
    return out.filter("xr > xl")


def polygon_cells(polygons: DataFrame, ident: str, rings: str, tile: float) -> DataFrame:
    """ident, col, row, pieces, and whether the polygon covers the whole cell."""
    edges = polygon_edges(polygons, ident, rings)
    pieces = clipped_edges(edges, ident, tile).unionByName(covered_tops(edges, ident, tile))
    cells = pieces.groupBy(ident, "col", "row").agg(F.collect_list(F.struct("xl", "yl", "xr", "yr")).alias("pieces"))
    one = F.col("pieces")[0]
    whole = (F.size("pieces") == 1) & (one["yl"] == one["yr"]) & (one["yl"] == (F.col("row") + 1) * F.lit(tile))
    whole = whole & (one["xl"] == F.col("col") * F.lit(tile)) & (one["xr"] == (F.col("col") + 1) * F.lit(tile))
    return cells.withColumn("whole", whole)


def _heights(pieces: np.ndarray, x: float, floor: float) -> list[tuple[float, float]]:
    """Stretches (low, high) of a polygon at a place, from above."""
    own = pieces[(pieces[:, 0] < x) & (x < pieces[:, 2])]
    ys = sorted((own[:, 1] + (x - own[:, 0]) * (own[:, 3] - own[:, 1]) / (own[:, 2] - own[:, 0])).tolist(), reverse=True)
    if len(ys) % 2:
        ys.append(floor)
    return [(ys[i + 1], ys[i]) for i in range(0, len(ys), 2)]


def shared_area(a: np.ndarray, b: np.ndarray | None, floor: float) -> float:
    """Area that two lists of pieces (xl, yl, xr, yr) of one cell share; without a second one, the area of the first."""
    every = a if b is None else np.concatenate([a, b])
    left, right = np.maximum.outer(every[:, 0], every[:, 0]), np.minimum.outer(every[:, 2], every[:, 2])
    i, j = np.nonzero(np.triu(right > left, 1))
    low, high = left[i, j], right[i, j]

    def y(k: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = every[k]
        return p[:, 1] + (x - p[:, 0]) * (p[:, 3] - p[:, 1]) / (p[:, 2] - p[:, 0])

    before, after = y(i, low) - y(j, low), y(i, high) - y(j, high)
    cross = before * after < 0
    met = low[cross] + (high - low)[cross] * before[cross] / (before - after)[cross]
    cuts = np.unique(np.concatenate([every[:, 0], every[:, 2], met])).tolist()
    total = 0.0
    for p, q in zip(cuts, cuts[1:]):
        mid = (p + q) / 2
        own = _heights(a, mid, floor)
        if b is None:
            total += (q - p) * sum(high - low for low, high in own)
        elif own:
            total += (q - p) * sum(max(0.0, min(h, k) - max(g, f)) for g, h in own for f, k in _heights(b, mid, floor))
    return total


def _areas(tile: float, lists: Sequence[str]):
    """Adds the area that the lists of a row's cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_pylist()
            parts = [[np.array([(p["xl"], p["yl"], p["xr"], p["yr"]) for p in own]) for own in batch.column(c).to_pylist()] for c in lists]
            area = [shared_area(parts[0][n], parts[1][n] if len(parts) > 1 else None, row * tile) for n, row in enumerate(rows)]
            keep = [n for n in batch.schema.names if n not in (*lists, "col", "row")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(area, pa.float64())], names=[*keep, "area"])

    return run


def _tile_of(layers: Sequence[DataFrame]) -> float:
    """Side of cells that hold a few edges each, from the number of edges and the bounds of both layers."""
    every = layers[0].select("xa", "ya").unionByName(layers[1].select("xa", "ya"))
    s = every.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f.__name__ + c) for c in ("xa", "ya") for f in (F.min, F.max)]).first()
    if not s["n"]:
        return 1.0
    wide, tall = s["maxxa"] - s["minxa"], s["maxya"] - s["minya"]
    return float(np.sqrt(max(wide, 1e-12) * max(tall, 1e-12) * EDGES_PER_CELL / s["n"]))


def overlay_areas(areas: DataFrame, zones: DataFrame, area_id: str, zone_id: str, tile: float | None = None, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """(area, zone, shared) of all pairs that share something, and (area, own)."""
    layers = [areas.select(F.col(f"`{area_id}`").alias("__a"), F.col(f"`{rings}`").alias("__rings")), zones.select(F.col(f"`{zone_id}`").alias("__z"), F.col(f"`{rings}`").alias("__rings"))]
    tile = tile or _tile_of([polygon_edges(layer, layer.columns[0], "__rings") for layer in layers])
    a, z = (polygon_cells(layer, layer.columns[0], "__rings", tile) for layer in layers)
    kind, other = (layer.schema[0].dataType.simpleString() for layer in layers)
    part = a.filter("NOT whole").select("__a", "col", "row", "pieces").mapInArrow(_areas(tile, ["pieces"]), f"__a {kind}, area double")
    full = F.lit(tile * tile).alias("area")
    own = part.unionByName(a.filter("whole").select("__a", full)).groupBy("__a").agg(F.sum("area").alias("own"))
    right = z.select("__z", "col", "row", F.col("pieces").alias("z_pieces"), F.col("whole").alias("z_whole"))
    met = a.join(right, ["col", "row"])
    cut = met.filter("NOT (whole AND z_whole)").select("__a", "__z", "col", "row", "pieces", "z_pieces")
    cut = cut.mapInArrow(_areas(tile, ["pieces", "z_pieces"]), f"__a {kind}, __z {other}, area double")
    shared = cut.unionByName(met.filter("whole AND z_whole").select("__a", "__z", full)).groupBy("__a", "__z").agg(F.sum("area").alias("shared"))
    return shared.filter("shared > 0").withColumnsRenamed({"__a": area_id, "__z": zone_id}), own.withColumnRenamed("__a", area_id)


def overlay_ratio(
    areas: DataFrame, zones: DataFrame, area_id: str, zone_id: str, tile: float | None = None, rings: str = "rings", min_ratio: float = 0.55,
) -> DataFrame:
    """Pairs of polygons whose shared part is at least ``min_ratio`` of the area: ids, shared, own, area_ratio.

    Areas are exact up to rounding. ``tile`` is the side of a cell; by default cells hold a
    few edges each. It changes nothing but the work. Rings of fewer than three points bound
    nothing; polygons without rings share nothing.
    """
    shared, own = overlay_areas(areas, zones, area_id, zone_id, tile, rings)
    ratio = shared.join(own, area_id).withColumn("area_ratio", F.col("shared") / F.col("own"))
    return ratio.filter(F.col("area_ratio") >= min_ratio)
