"""Evaluation of predictions over area levels, spatial clusters and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core.session import cut_lineage
from surveyspark.core.stats import correlation
from surveyspark.operators.aggregates import regression_metrics, split_statistics
from surveyspark.operators.positions import position_levels
from surveyspark.operators.quality import clip_sigma, moments_of, trim_sigma
from surveyspark.operators.transforms import Scaling, fit_scaling, flip_sign

LEVELS = {"adm2": ["adm2_name", "adm1_name", "adm0_name"], "adm1": ["adm1_name", "adm0_name"], "adm0": ["adm0_name"]}
# Radii in kilometres of the cluster evaluation, and the year optical images begin.
RADII_KM = [0.1, 0.2, 0.3, 0.5, 0.7, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20]
SPLIT_YEAR = 2015


def sigma_tags(df: DataFrame, value: str, widths: Sequence[float | None] = (None, 3, 2)) -> Column:
    """Names of the deviation filters a row passes: ``None``, ``3``, ``2``."""
    ms = moments_of(df, value)
    tags = []
    for w in widths:
        if w is None:
            tags.append(F.lit("None"))
        else:
            inside = (F.col(value) <= ms["m"] + w * ms["s"]) & (F.col(value) >= ms["m"] - w * ms["s"])
            tags.append(F.when(inside, F.lit(f"{w:g}")))
    return F.array_compact(F.array(*tags))


def area_rollup(
    df: DataFrame, values: Sequence[str] = ("Actual", "Prediction"), year: str = "DHSYEAR", area: str = "URBAN_RURA",
    households: str = "households", sigma_on: str = "Actual", widths: Sequence[float | None] = (None, 3, 2),
) -> DataFrame:
    """Means, clusters and households for every level × (with year or not) × (All, Urban, Rural) × deviation filter.

    The rows are added up once at the finest grain; all levels are sums over that table.
    """
    tagged = df.withColumn("sigma", F.explode(sigma_tags(df, sigma_on, widths)))
    keys = ["adm0_name", "adm1_name", "adm2_name", year, area, "sigma"]
    aggs = [F.count(F.lit(1)).alias("clusters"), F.sum(households).alias("households_sum")]
    for v in values:
        aggs += [F.sum(v).alias(f"__s_{v}"), F.count(v).alias(f"__n_{v}")]
    fine = tagged.groupBy(*keys).agg(*aggs)
    member = F.array_compact(
        F.array(F.lit("All"), F.when(F.col(area) == "U", "Urban").when(F.col(area) == "R", "Rural"))
    )
    combos = []
    for level, cols in LEVELS.items():
        for with_year in (False, True):
            combos.append(
                F.struct(
                    F.lit(level).alias("level"),
                    F.lit(with_year).alias("by_year"),
                    *[
                        (F.col(c) if c in cols else F.lit(None).cast("string")).alias(c)
                        for c in ("adm0_name", "adm1_name", "adm2_name")
                    ],
                    (F.col(year) if with_year else F.lit(None).cast(df.schema[year].dataType)).alias(year),
                    (
                        F.col("adm0_name").isNotNull()
                        & (F.col("adm1_name").isNotNull() if "adm1_name" in cols else F.lit(True))
                        & (F.col("adm2_name").isNotNull() if "adm2_name" in cols else F.lit(True))
                        & (F.col(year).isNotNull() if with_year else F.lit(True))
                    ).alias("known"),
                )
            )
    sums = [c for c in fine.columns if c not in keys]
    wide = fine.select("sigma", F.explode(member).alias("member"), F.array(*combos).alias("cs"), *sums)
    long = wide.select("sigma", "member", F.explode("cs").alias("c"), *sums).filter("c.known")
    out = long.groupBy("sigma", "member", "c.level", "c.by_year", "c.adm0_name", "c.adm1_name", "c.adm2_name", f"c.{year}").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    for v in values:
        out = out.withColumn(v, F.col(f"__s_{v}") / F.nullif(F.col(f"__n_{v}"), F.lit(0))).drop(f"__s_{v}", f"__n_{v}")
    return out


def row_slices(df: DataFrame, focus: str, year: str = "DHSYEAR", area: str = "URBAN_RURA", sigma_on: str = "Actual") -> DataFrame:
    """Rows repeated for every slice they belong to: region type, period, one country, deviation filter."""
    urban, rural = F.col(area) == "U", F.col(area) == "R"
    before, since = F.col(year) < SPLIT_YEAR, F.col(year) >= SPLIT_YEAR
    here = F.col("adm0_name") == focus
    named = {
        "Urban": urban, "Rural": rural, focus: here, f"{focus} urban": urban & here, f"{focus} rural": rural & here,
        "Before 2015": before, "Since 2015": since, "Urban before 2015": urban & before,
        "Urban Since 2015": urban & since, "Rural before 2015": rural & before, "Rural Since 2015": rural & since,
    }
    members = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    sliced = df.withColumn("__sigma", F.explode(sigma_tags(df, sigma_on))).withColumn("__m", F.explode(members))
    return sliced.withColumn("slice", F.concat(F.col("__m"), F.lit(" STD "), F.col("__sigma"))).drop("__m", "__sigma")


def rollup_slices(rollup: DataFrame, focus: str, year: str = "DHSYEAR") -> DataFrame:
    """Rows of the area roll-up repeated for their named slices."""
    base = F.concat(F.col("member"), F.lit(" "), F.col("level"), F.when(F.col("by_year"), " Year").otherwise(""))
    end = F.concat(F.lit(" STD "), F.col("sigma"))
    names = F.array_compact(
        F.array(
            F.concat(base, end),
            F.when(F.col("by_year") & (F.col(year) >= SPLIT_YEAR), F.concat(base, F.lit(" since 2015"), end)),
            F.when(F.col("by_year") & (F.col(year) < SPLIT_YEAR), F.concat(base, F.lit(" before 2015"), end)),
            F.when(F.col("adm0_name") == focus, F.concat(base, F.lit(f" {focus}"), end)),
        )
    )
    return rollup.withColumn("slice", F.explode(names))


def slice_report(
    test: DataFrame, val: DataFrame | None, focus: str, actual: str = "Actual", predicted: str = "Prediction", min_rows: int = 3
) -> DataFrame:
    """Regression metrics of every slice: whole test and validation, row slices and area roll-ups."""
    cols = [actual, predicted]
    parts = [test.select(F.lit("Test").alias("slice"), *cols)]
    if val is not None:
        parts.append(val.select(F.lit("Val").alias("slice"), *cols))
    parts.append(row_slices(test, focus, sigma_on=actual).select("slice", *cols))
    roll = area_rollup(test, values=cols, sigma_on=actual)
    parts.append(rollup_slices(roll, focus).select("slice", *cols))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy("slice").agg(*regression_metrics(actual, predicted)).filter(F.col("size") >= min_rows)


def report_row(report: DataFrame, slices: Sequence[str], metrics: Sequence[str] = ("slope", "intercept", "pearson", "rmse", "nrmse", "r2")) -> DataFrame:
    """The report as one row with columns ``<slice> <metric>``."""
    return report.agg(
        *[F.max(F.when(F.col("slice") == s, F.col(m))).alias(f"{s} {m}") for s in slices for m in metrics]
    )


def _metric_set(prefix: str) -> list[Column]:
    a, p = F.col("Actual"), F.col("Prediction")
    return [
        F.count(F.lit(1)).alias(f"{prefix}_size"),
        F.sqrt(F.avg(F.pow(p - a, 2))).alias(f"{prefix}_rmse"),
        correlation(a, p).alias(f"{prefix}_corr"),
    ]


def cluster_evaluation(df: DataFrame, radii: Sequence[float] = RADII_KM, by_year: bool = False, year: str = "DHSYEAR") -> DataFrame:
    """Metrics of cluster means, clustered rows and other rows, per radius and region mode.

    Modes: All; U and R (rows of that type, groups of at least two); U+R (all rows of
    groups with an urban row). Also the mean deviation inside clusters, and between the
    years of a cluster when clusters are split by year. All radii are clustered and
    evaluated together, ``distance`` being one more key.
    """
    per = ["distance", "mode"]
    keys = [*per, "clustered", year] if by_year else [*per, "clustered"]
    area = F.col("URBAN_RURA")
    modes = F.array_compact(F.array(F.lit("All"), F.when(area.isin("U", "R"), area), F.lit("U+R")))
    cols = {"URBAN_RURA", "Actual", "Prediction", "LATNUM", "LONGNUM", *([year] if by_year else [])}
    tagged = cut_lineage(position_levels(df.select(*[c for c in df.columns if c in cols]), radii).withColumn("mode", F.explode(modes)))
    inside = tagged.filter("clustered IS NOT NULL")
    sizes = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max((area == "U").cast("int")).alias("__u"))
    counted = tagged.join(sizes, keys, "left")
    lone = F.col("clustered").isNull()
    urban_group = (F.col("mode") != "U+R") | (F.coalesce(F.col("__u"), F.lit(0)) == 1)
    grouped = ~lone & urban_group & ((F.col("mode") == "All") | (F.col("__n") >= 2))
    outside = lone | (~lone & urban_group & (F.col("mode") != "All") & (F.col("__n") == 1))
    marked = cut_lineage(counted.select(*keys, "Actual", "Prediction", grouped.alias("__in"), outside.alias("__out")))
    in_rows, out_rows = marked.filter("__in"), marked.filter("__out")
    means = in_rows.groupBy(*keys).agg(
        F.avg("Actual").alias("Actual"), F.avg("Prediction").alias("Prediction"),
        F.stddev_samp("Actual").alias("__sa"), F.stddev_samp("Prediction").alias("__sp"),
    )
    agg = means.groupBy(*per).agg(
        *_metric_set("clustered"), F.avg("__sa").alias("actual_std_in_cluster"), F.avg("__sp").alias("prediction_std_in_cluster")
    )
    out = agg.join(in_rows.groupBy(*per).agg(*_metric_set("in_cluster")), per, "full").join(
        out_rows.groupBy(*per).agg(*_metric_set("out_of_cluster")), per, "full"
    )
    if by_year:
        years = means.groupBy(*per, "clustered").agg(F.stddev_samp("Actual").alias("a"), F.stddev_samp("Prediction").alias("p"))
        between = years.groupBy(*per).agg(F.avg("a").alias("actual_std_between_years"), F.avg("p").alias("prediction_std_between_years"))
        out = out.join(between, per, "left")
    return out


def evaluate_split(
    labels: DataFrame, predictions: DataFrame, key: str, scaling: Scaling | None = None
) -> tuple[DataFrame, DataFrame]:
    """Labels with their prediction, in scaled and original units, and the metrics of both."""
    rows = labels.join(predictions.select(key, "Prediction"), key).withColumn("Actual", F.col("label"))
    metrics = rows.agg(*regression_metrics("Actual", "Prediction")).withColumn("units", F.lit("scaled"))
    if scaling is not None:
        rows = rows.withColumns(
            {
                "Actual Original Data": scaling.invert(F.col("Actual")),
                "Pred Original Data": scaling.invert(F.col("Prediction")),
            }
        )
        metrics = metrics.unionByName(
            rows.agg(*regression_metrics("Actual Original Data", "Pred Original Data")).withColumn("units", F.lit("original"))
        )
    return rows, metrics


# How far a split may differ from the whole before a warning.
MEAN_DRIFT, SHAPE_DRIFT, SMALL_SPLIT, LARGE_SPLIT = 0.05, 0.1, 0.08, 0.22


def split_drift(stats: DataFrame, whole: str = "whole ds") -> DataFrame:
    """Per split the differences to the whole and the warnings they cause.

    ``stats``: slice, size, mean, std, skew, kurtosis.
    """
    w = stats.filter(F.col("slice") == whole).agg(
        F.struct(*[F.max(c).alias(c) for c in ("size", "mean", "std", "skew", "kurtosis")]).alias("w")
    ).scalar()
    diffs = {f"{c}_diff": F.abs(F.col(c) - w[c]) for c in ("mean", "std", "skew", "kurtosis")}
    out = stats.filter(~F.col("slice").isin(whole, "assigned")).withColumns({**diffs, "share": F.col("size") / w["size"]})
    return out.withColumn(
        "warnings",
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(F.col("mean_diff") > MEAN_DRIFT, "mean"),
                    F.when(F.col("std_diff") > SHAPE_DRIFT, "std"),
                    F.when(F.col("skew_diff") > SHAPE_DRIFT, "skew"),
                    F.when(F.col("kurtosis_diff") > SHAPE_DRIFT, "kurtosis"),
                    F.when((F.col("share") <= SMALL_SPLIT) | (F.col("share") >= LARGE_SPLIT), "size"),
                )
            ),
            ",",
        ),
    )


def prepare_regression_labels(
    df: DataFrame, label: str, split: str, reverse: bool = False, low: float | None = None, high: float | None = None,
    drop: bool = False, transform: str | None = None, normalise: str | None = None,
) -> tuple[DataFrame, Scaling, DataFrame]:
    """Labels turned, trimmed or clipped, transformed and scaled: rows with ``label``, parameters, moments per split.

    ``low`` / ``high`` are bounds in deviations from the mean; beyond them rows are dropped
    (``drop``) or set to the bound. The moments can be passed to ``split_drift``.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(split).isNotNull()).withColumn("label", F.col(label).cast("double"))
    if reverse:
        rows = flip_sign(rows, "label")
    if low is not None or high is not None:
        rows = trim_sigma(rows, "label", low, high) if drop else clip_sigma(rows, "label", low, high)
    scaling = fit_scaling(rows, "label", transform, normalise)
    rows = rows.withColumn("label", scaling.apply(F.col("label")))
    return rows, scaling, split_statistics(rows, split, "label")
