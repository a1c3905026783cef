"""Image tiles as rows: tile_id, band, height, width, px (row by row, NaN where unknown)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crop_centre(df: DataFrame, height: int, width: int) -> DataFrame:
    """Middle ``height`` × ``width`` pixels; a smaller tile is an error."""
    top = F.floor((F.col("height") - height) / 2)
    left = F.floor((F.col("width") - width) / 2)
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(height - 1)),
        lambda r: F.slice("px", ((top + r) * F.col("width") + left + 1).cast("int"), F.lit(width)),
    )
    fits = (F.col("height") >= height) & (F.col("width") >= width)
    too_small = F.raise_error(F.concat(F.lit("tile too small: "), F.col("tile_id").cast("string"))).cast("array<array<float>>")
    return df.withColumn("px", F.flatten(F.when(fits, rows).otherwise(too_small))).withColumns(
        {"height": F.lit(height), "width": F.lit(width)}
    )


def _unknown(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def pixel_moments(px: Column) -> Column:
    """Struct (n, mean, m2) of the known pixels: count, mean and squared deviations from it.

    One pass over the array with running means, so a large offset doesn't cancel.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, v: Column) -> Column:
        n = acc["n"] + F.lit(1.0)
        d = v.cast("double") - acc["mean"]
        mean = acc["mean"] + d / n
        more = F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + d * (v.cast("double") - mean)).alias("m2"))
        return F.when(_unknown(v), acc).otherwise(more)

    return F.aggregate(px, zero, add)


def joined_moments(parts: Column) -> Column:
    """Moments of a short array of moments (the bands of a tile) together."""
    n = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / F.nullif(n, F.lit(0.0))
    m2 = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean))
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def mean_of(moments: Column) -> Column:
    return F.when(moments["n"] > 0, moments["mean"])


def std_of(moments: Column) -> Column:
    """Population deviation."""
    return F.when(moments["n"] > 0, F.sqrt(moments["m2"] / moments["n"]))


def per_pixel(px: Column, fn, *values: Column) -> Column:
    """``fn(pixel, values)`` for every pixel.

    The values go in as an array as long as the tile, so they are computed once per tile and
    not once per pixel.
    """
    shared = F.array_repeat(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), F.size(px))
    return F.zip_with(px, shared, lambda v, k: fn(v, *[k[f"v{i}"] for i in range(len(values))]).cast("float"))


def fill_unknown(df: DataFrame, fill: float | dict[int, float] | str = "band mean") -> DataFrame:
    """Unknown pixels set to a constant, a value per band or the mean of the tile's band; adds ``nan_percent``."""
    out = df.withColumn("__p", pixel_moments(F.col("px")))
    if fill == "band mean":
        value = mean_of(F.col("__p"))
    elif isinstance(fill, dict):
        pairs = F.create_map(*[F.lit(x) for k, v in fill.items() for x in (k, float(v))])
        value = F.try_element_at(pairs, F.col("band"))
    else:
        value = F.lit(float(fill))
    missing = (F.size("px") - F.col("__p.n")) / F.size("px") * 100
    return out.withColumns(
        {"nan_percent": missing, "px": per_pixel(F.col("px"), lambda v, f: F.when(_unknown(v), f).otherwise(v), value)}
    ).drop("__p")


def clip_pixels(df: DataFrame, low: float | None = None, high: float | None = None, sigmas: float | None = None) -> DataFrame:
    """Pixels limited to fixed bounds, or to mean ± ``sigmas`` population deviations of the tile's band."""

    def limit(v: Column, lo: Column, hi: Column) -> Column:
        return F.least(F.greatest(v.cast("double"), lo), hi)

    if sigmas is None:
        return df.withColumn("px", per_pixel(F.col("px"), limit, F.lit(float(low)), F.lit(float(high))))
    out = df.withColumn("__p", pixel_moments(F.col("px")))
    m, s = mean_of(F.col("__p")), std_of(F.col("__p"))
    return out.withColumn("px", per_pixel(F.col("px"), limit, m - sigmas * s, m + sigmas * s)).drop("__p")


def _missing_share(df: DataFrame) -> DataFrame:
    """Percent of unknown pixels per tile over all its bands."""
    part = df.select("tile_id", F.size("px").alias("size"), pixel_moments(F.col("px"))["n"].alias("n"))
    return part.groupBy("tile_id").agg(((F.sum("size") - F.sum("n")) / F.sum("size") * 100).alias("nan_percent"))


def drop_incomplete(df: DataFrame, max_nan_percent: float) -> DataFrame:
    """Tiles whose share of unknown pixels over all bands is below the limit."""
    good = _missing_share(df).filter(F.col("nan_percent") < max_nan_percent)
    return df.join(good.select("tile_id"), "tile_id", "left_semi")


def nan_ledger(df: DataFrame) -> DataFrame:
    """Tiles with unknown pixels and their share."""
    return _missing_share(df).filter("nan_percent > 0")


def corpus_statistics(df: DataFrame, keys: tuple[str, ...] = ("band",), per_file: bool = False) -> DataFrame:
    """Mean and population deviation per band over all pixels, or as mean over files.

    Every tile adds its moments, the pixels are not exploded; means are found before the
    deviations from them.
    """
    part = df.select(*keys, pixel_moments(F.col("px")).alias("p"))
    if per_file:  # deviations inside a file and of its mean from the mean of all files
        one = part.filter("p.n > 0").select(*keys, F.col("p.mean").alias("m"), (F.col("p.m2") / F.col("p.n")).alias("v"))
        return one.groupBy(*keys).agg(F.avg("m").alias("mean"), F.sqrt(F.avg("v") + F.var_pop("m")).alias("std"))
    part = part.withColumn("__g", F.struct(*keys))  # as a struct, null keys meet each other
    total = F.nullif(F.sum("p.n"), F.lit(0.0))
    centre = part.groupBy("__g").agg((F.sum(F.col("p.n") * F.col("p.mean")) / total).alias("mean"))
    away = F.col("p.mean") - F.col("mean")
    out = part.join(centre, "__g").groupBy(*keys, "mean").agg(F.sqrt(F.sum(F.col("p.m2") + F.col("p.n") * away * away) / total).alias("std"))
    return out.select(*keys, "mean", "std")


def normalise_tiles(df: DataFrame, mode: str = "Z", stats: DataFrame | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """``Z``: corpus mean and deviation of the band; ``Z local``: those of the tile; ``Z combined``:
    the average of both; ``all channel``: one mean and deviation over all bands of the tile."""
    out = df
    if mode in ("Z local", "Z combined", "all channel"):
        out = out.withColumn("__p", pixel_moments(F.col("px")))
    if mode in ("Z", "Z combined"):
        stats = corpus_statistics(df, keys) if stats is None else stats
        out = out.join(stats.select(*keys, F.col("mean").alias("__cm"), F.col("std").alias("__cs")), list(keys))
    if mode == "all channel":
        tile = out.groupBy("tile_id").agg(joined_moments(F.collect_list("__p")).alias("__t"))
        out = out.join(tile, "tile_id")
    if mode == "Z":
        m, s = F.col("__cm"), F.col("__cs")
    elif mode == "Z local":
        m, s = mean_of(F.col("__p")), std_of(F.col("__p"))
    elif mode == "Z combined":
        m, s = (F.col("__cm") + mean_of(F.col("__p"))) / 2, (F.col("__cs") + std_of(F.col("__p"))) / 2
    elif mode == "all channel":
        m, s = mean_of(F.col("__t")), std_of(F.col("__t"))
    else:
        raise ValueError(f"unknown normalisation {mode}")
    scaled = per_pixel(F.col("px"), lambda v, a, b: (v - a) / F.when(b > 0, b).otherwise(1.0), m, s)
    return out.withColumn("px", scaled).drop("__p", "__cm", "__cs", "__t")


def standardise_by_split(df: DataFrame, split: str, own: bool = False, train: str = "train") -> DataFrame:
    """Tiles standardised with the training statistics of their band, or with those of their own split."""
    if own:
        return normalise_tiles(df, "Z", corpus_statistics(df, ("band", split)), ("band", split))
    return normalise_tiles(df, "Z", corpus_statistics(df.filter(F.col(split) == train)))


def add_band(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Bands of a second sensor appended after the last band, for tiles that have both."""
    last = df.agg(F.max("band").alias("b")).scalar()
    both = extra.join(df.select("tile_id").distinct(), "tile_id", "left_semi")
    have = df.join(extra.select("tile_id").distinct(), "tile_id", "left_semi")
    return have.unionByName(both.withColumn("band", (F.col("band") + last + 1).cast(df.schema["band"].dataType)))


def median_composite(pixels: DataFrame, max_probability: int = 20) -> DataFrame:
    """Median over time of every pixel and band that is not cloudy.

    ``pixels``: scene, tile_id, band, x, y, value, probability. A pixel has as many values
    as there are scenes in the period, so the grouping key spreads the work over all pixels.
    """
    clear = pixels.filter((F.col("probability") < max_probability) & F.col("value").isNotNull())
    return clear.groupBy("tile_id", "band", "x", "y").agg(F.median("value").alias("value"), F.count(F.lit(1)).alias("scenes"))


def tile_kind(height: Column | str, limit: int = 500) -> Column:
    h = F.col(height) if isinstance(height, str) else height
    return F.when(h < limit, "urban").otherwise("rural")
