"""Operators on image tiles; the vectors of the driver tables play tiles of eight by eight pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions import geo
from surveyspark.operators import raster as rs
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views

_PX = "x AS (SELECT tile_id, band, unnest(px) AS v, unnest(range(64)) AS i FROM tiles)"


def _gappy(t: Tables):
    """Tiles with every seventh pixel unknown in some tiles."""
    gap = F.transform("px", lambda v, i: F.when((F.col("tile_id") % 4 == 0) & ((i + F.col("tile_id")) % 7 == 0), F.lit(float("nan"))).otherwise(v).cast("float"))
    return t.tiles.withColumn("px", gap)


_GAPPY = "x AS (SELECT tile_id, band, i, CASE WHEN tile_id % 4 = 0 AND (i + tile_id) % 7 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END AS v FROM (SELECT tile_id, band, unnest(px) AS v, unnest(range(64)) AS i FROM tiles))"


def _long(df):
    return df.select("tile_id", "band", F.posexplode("px").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query(
    "cropped_tiles",
    ["RS-1", "SC-13"],
    f"{oracle_views('tiles')}, {_PX} SELECT tile_id, band, CAST((i // 8 - 2) * 4 + i % 8 - 2 AS INT) AS i, {r('CAST(v AS DOUBLE)')} AS v FROM x WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5",
)
def cropped_tiles(t: Tables):
    return rounded(_long(rs.crop_centre(t.tiles, 4, 4)))


@query(
    "filled_tiles",
    ["RS-2"],
    f"""{oracle_views('tiles')}, {_GAPPY}, m AS (SELECT tile_id, avg(v) AS m, (64 - count(v)) / 64 * 100 AS p FROM x GROUP BY tile_id)
        SELECT tile_id, band, CAST(i AS INT) AS i, {r('COALESCE(v, m)', 5)} AS v, {r('p')} AS nan_percent FROM x JOIN m USING (tile_id)""",
)
def filled_tiles(t: Tables):
    out = rs.fill_unknown(_gappy(t))
    long = out.select("tile_id", "band", F.posexplode("px").alias("i", "v"), "nan_percent")
    return rounded(long.withColumn("v", F.round(F.col("v").cast("double"), 5)))


@query(
    "clipped_tiles",
    ["RS-3"],
    f"""{oracle_views('tiles')}, {_PX}, m AS (SELECT tile_id, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS s FROM x GROUP BY tile_id)
        SELECT tile_id, band, CAST(i AS INT) AS i, {r('least(greatest(CAST(v AS DOUBLE), m - 1.5 * s), m + 1.5 * s)', 4)} AS v FROM x JOIN m USING (tile_id)""",
)
def clipped_tiles(t: Tables):
    return rounded(_long(rs.clip_pixels(t.tiles, sigmas=1.5)), 4)


@query("complete_tiles", ["RS-4"], f"{oracle_views('tiles')}, {_GAPPY} SELECT tile_id FROM x GROUP BY tile_id HAVING (64 - count(v)) / 64 * 100 < 14.5")
def complete_tiles(t: Tables):
    return rs.drop_incomplete(_gappy(t), 14.5).select("tile_id")


@query("nan_ledger", ["RS-4"], f"{oracle_views('tiles')}, {_GAPPY} SELECT tile_id, {r('(64 - count(v)) / 64 * 100')} AS nan_percent FROM x GROUP BY tile_id HAVING count(v) < 64")
def nan_ledger(t: Tables):
    return rounded(rs.nan_ledger(_gappy(t)))


@query("corpus_statistics", ["RS-5"], f"{oracle_views('tiles')}, {_GAPPY} SELECT band, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std FROM x GROUP BY band")
def corpus_statistics(t: Tables):
    return rounded(rs.corpus_statistics(_gappy(t)))


@query(
    "corpus_statistics_per_file",
    ["RS-5"],
    f"""{oracle_views('tiles')}, {_GAPPY}, f AS (SELECT band, tile_id, avg(v) AS m FROM x GROUP BY ALL), c AS (SELECT band, avg(m) AS m FROM f GROUP BY band),
        d AS (SELECT x.band, tile_id, avg(power(v - c.m, 2)) AS d FROM x JOIN c USING (band) GROUP BY ALL)
        SELECT c.band, {r('any_value(c.m)')} AS mean, {r('sqrt(avg(d))')} AS std FROM d JOIN c USING (band) GROUP BY c.band""",
)
def corpus_statistics_per_file(t: Tables):
    return rounded(rs.corpus_statistics(_gappy(t), per_file=True))


@query(
    "normalised_tiles",
    ["RS-6"],
    f"""{oracle_views('tiles')}, {_PX}, b AS (SELECT band, avg(CAST(v AS DOUBLE)) AS bm, stddev_pop(CAST(v AS DOUBLE)) AS bs FROM x GROUP BY band),
        m AS (SELECT tile_id, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS s FROM x GROUP BY tile_id)
        SELECT tile_id, 'Z' AS mode, {r('avg((v - bm) / bs)', 4)} AS mean, {r('max((v - bm) / bs)', 4)} AS top FROM x JOIN b USING (band) GROUP BY tile_id
        UNION ALL SELECT tile_id, 'Z local', {r('avg((v - m) / s)', 4)}, {r('max((v - m) / s)', 4)} FROM x JOIN m USING (tile_id) GROUP BY tile_id
        UNION ALL SELECT tile_id, 'Z combined', {r('avg((v - (m + bm) / 2) / ((s + bs) / 2))', 4)}, {r('max((v - (m + bm) / 2) / ((s + bs) / 2))', 4)} FROM x JOIN m USING (tile_id) JOIN b USING (band) GROUP BY tile_id
        UNION ALL SELECT tile_id, 'all channel', {r('avg((v - m) / s)', 4)}, {r('max((v - m) / s)', 4)} FROM x JOIN m USING (tile_id) GROUP BY tile_id""",
)
def normalised_tiles(t: Tables):
    out = None
    for mode in ("Z", "Z local", "Z combined", "all channel"):
        px = rs.normalise_tiles(t.tiles, mode)
        total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v.cast("double"))
        part = px.select("tile_id", F.lit(mode).alias("mode"), (total / F.size("px")).alias("mean"), F.array_max("px").cast("double").alias("top"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query(
    "split_standardised_tiles",
    ["RS-7"],
    f"""{oracle_views('tiles')}, {_PX}, s AS (SELECT *, CASE WHEN tile_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM x),
        b AS (SELECT band, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM s WHERE split = 'train' GROUP BY band)
        SELECT tile_id, band, split, {r('avg((v - m) / sd)', 4)} AS mean FROM s JOIN b USING (band) GROUP BY tile_id, band, split
        UNION ALL SELECT tile_id, 3, split, {r('avg(v * 2.0)', 4)} FROM s WHERE tile_id % 2 = 0 GROUP BY tile_id, split""",
)
def split_standardised_tiles(t: Tables):
    rows = t.tiles.withColumn("split", F.when(F.col("tile_id") % 5 == 0, "test").otherwise("train"))
    std = rs.standardise_by_split(rows, "split")
    extra = rows.filter("tile_id % 2 = 0").withColumns({"band": F.lit(0), "px": F.transform("px", lambda v: (v * 2).cast("float"))})
    lone = std.join(extra.select("tile_id").distinct(), "tile_id", "left_anti")
    both = rs.add_band(std, extra).unionByName(lone)
    total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rounded(both.select("tile_id", "band", "split", (total / F.size("px")).alias("mean")), 4)


@query("tile_kinds", ["RS-9"], "SELECT vec_id, CASE WHEN vec_id * 7 % 1000 < 500 THEN 'urban' ELSE 'rural' END AS kind FROM embeddings")
def tile_kinds(t: Tables):
    return t.embeddings.select("vec_id", rs.tile_kind(F.col("vec_id") * 7 % 1000).alias("kind"))


@query(
    "tile_centres",
    ["RS-10"],
    f"{oracle_views('clusters')} SELECT cluster, {r('LONGNUM + 0.01 * 0.5')} AS lon, {r('LATNUM - 0.01 * 0.5')} AS lat, {r('LONGNUM + 0.01 * 50.5')} AS mid_lon, {r('LATNUM - 0.01 * 50.5')} AS mid_lat FROM clusters",
)
def tile_centres(t: Tables):
    affine = {"a": F.lit(0.01), "b": F.lit(0.0), "c": F.col("LONGNUM"), "d": F.lit(0.0), "e": F.lit(-0.01), "f": F.col("LATNUM")}
    lon, lat = geo.tile_centre(affine, F.lit(100), F.lit(100))
    mid_lon, mid_lat = geo.tile_centre(affine, F.lit(100), F.lit(100), edges=False)
    return rounded(t.clusters.select("cluster", lon.alias("lon"), lat.alias("lat"), mid_lon.alias("mid_lon"), mid_lat.alias("mid_lat")))
