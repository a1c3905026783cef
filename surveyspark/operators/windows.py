"""Values of a group or of neighbouring rows brought to each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.core.stats import correlation
from surveyspark.core.ordering import carry, dense_index, exact_quantiles, rolling, value_positions


def with_group_median_date(df: DataFrame, keys: Sequence[str], date: str, out: str = "median_date") -> DataFrame:
    """Median date of the group on every row; the half day of an even group is kept as a timestamp."""
    secs = df.withColumn("__d", F.unix_date(F.col(date).cast("date")).cast("double"))
    med = exact_quantiles(secs, keys, "__d", {"__m": 0.5})
    med = med.select(*keys, F.timestamp_seconds(F.col("__m") * 86400).alias(out))
    return df.join(med, list(keys), "left")


def with_rounded_group_year(df: DataFrame, key: str, year: str, out: str = "rounded year") -> DataFrame:
    """Mean year of the group, rounded half to even, on every row."""
    means = df.groupBy(key).agg(F.bround(F.avg(year), 0).cast("int").alias(out))
    return df.join(means, key, "left")


def rolling_pearson(
    df: DataFrame, keys: Sequence[str], pos: str, a: str, b: str, window: int, out: str = "rolling_r", block: int = 4096
) -> DataFrame:
    """Centred rolling correlation: ``window // 2`` rows before to ``window - window // 2 - 1`` after.

    Null where the frame is not full.
    """
    back = window // 2
    ahead = window - back - 1
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return rolling(
        df, keys, pos, back, ahead,
        {
            "__n": lambda w: F.count(F.when(both, 1)).over(w),
            "__r": lambda w: correlation(x, y, w),
            "__vx": lambda w: F.max(x).over(w) - F.min(x).over(w),
            "__vy": lambda w: F.max(y).over(w) - F.min(y).over(w),
        },
        block,
    ).withColumn(
        out, F.when((F.col("__n") == window) & (F.col("__vx") > 0) & (F.col("__vy") > 0), F.col("__r"))
    ).drop("__n", "__r", "__vx", "__vy")


def rolling_spearman(
    df: DataFrame, keys: Sequence[str], pos: str, a: str, b: str, window: int, out: str = "rolling_rho", block: int = 4096
) -> DataFrame:
    """Trailing rolling rank correlation; null before the first full frame.

    A frame holds ``window`` rows, so the collected lists are of fixed size.
    """

    def ranks(vals):
        return F.transform(
            vals,
            lambda v: F.size(F.filter(vals, lambda o: o < v)) + (F.size(F.filter(vals, lambda o: o == v)) + 1) / 2,
        )

    out_df = rolling(
        df, keys, pos, window - 1, 0,
        {
            "__a": lambda w: F.collect_list(F.col(a).cast("double")).over(w),
            "__b": lambda w: F.collect_list(F.col(b).cast("double")).over(w),
        },
        block,
    )
    ra, rb = ranks(F.col("__a")), ranks(F.col("__b"))
    mean = F.lit((window + 1) / 2)

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, s: (p - mean) * (s - mean)), F.lit(0.0), lambda t, v: t + v)

    out_df = out_df.withColumns({"__ra": ra, "__rb": rb}).withColumns(
        {
            "__xy": dot(F.col("__ra"), F.col("__rb")),
            "__xx": dot(F.col("__ra"), F.col("__ra")),
            "__yy": dot(F.col("__rb"), F.col("__rb")),
        }
    )
    full = (F.size("__a") == window) & (F.size("__b") == window) & (F.col("__xx") > 0) & (F.col("__yy") > 0)
    return out_df.withColumn(out, F.when(full, F.col("__xy") / F.sqrt(F.col("__xx") * F.col("__yy")))).drop(
        "__a", "__b", "__ra", "__rb", "__xy", "__xx", "__yy"
    )


def interpolate(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str | None = None, block: int = 4096) -> DataFrame:
    """Straight line between known neighbours, the last known value carried to the end, leading gaps left."""
    rows = carry(df, keys, pos, value, block)
    step = (F.col(pos) - F.col("prev_pos")) / F.nullif(F.col("next_pos") - F.col("prev_pos"), F.lit(0))
    line = F.col("prev_val") + (F.col("next_val") - F.col("prev_val")) * step
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(F.col("prev_val").isNotNull() & F.col("next_val").isNotNull(), line)
        .otherwise(F.col("prev_val").cast("double"))
    )
    return rows.withColumn(out or value, filled).drop("prev_pos", "prev_val", "next_pos", "next_val")


def weight_share(df: DataFrame, keys: Sequence[str], weight: str, out: str = "share") -> DataFrame:
    """Weight of the row over the weight of its group."""
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("__t"))
    return df.join(totals, list(keys)).withColumn(out, F.try_divide(F.col(weight), F.col("__t"))).drop("__t")


def number_duplicate_names(df: DataFrame, keys: Sequence[str], name: str, order: str) -> DataFrame:
    """Repeated names inside an area get `` 2``, `` 3``… along a unique order column."""
    idx = value_positions(df, [*keys, name], order).select(*keys, name, order, F.col("before").alias("__i"))
    return (
        df.join(idx, [*keys, name, order], "left")
        .withColumn("__new", F.when(F.col("__i") > 0, F.concat_ws(" ", F.col(name), F.col("__i") + 1)).otherwise(F.col(name)))
        .drop(name, "__i")
        .withColumnRenamed("__new", name)
    )


def top_one(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """Row with the highest score per group; ties take the smallest tie columns.

    An aggregation with map-side combining, so a hot group is reduced where it lies.
    """
    order = F.struct((-F.col(score)).alias("s"), *[F.col(t) for t in tie])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def groups_with(df: DataFrame, keys: Sequence[str], min_rows: int = 1, max_rows: int | None = None, any_flag=None) -> DataFrame:
    """Rows of groups within a size range and, if asked, with at least one flagged row."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    if any_flag is not None:
        aggs.append(F.max(any_flag.cast("int")).alias("__f"))
    sizes = df.groupBy(*keys).agg(*aggs).filter(F.col("__n") >= min_rows)
    if max_rows is not None:
        sizes = sizes.filter(F.col("__n") <= max_rows)
    if any_flag is not None:
        sizes = sizes.filter("__f = 1")
    return df.join(sizes.select(*keys), list(keys), "left_semi")


__all__ = [
    "dense_index", "groups_with", "interpolate", "number_duplicate_names", "rolling_pearson", "rolling_spearman",
    "top_one", "weight_share", "with_group_median_date", "with_rounded_group_year",
]
