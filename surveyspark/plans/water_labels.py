"""Drinking-water labels: from household answers to cluster labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.core.namespaces import quoted as q
from surveyspark.core.session import cut_lineage
from surveyspark.functions import recode as rc
from surveyspark.functions.calendar import MINUTE_TEXTS
from surveyspark.functions.text import null_tokens
from surveyspark.operators.aggregates import majority, mean_and_std
from surveyspark.operators.models import pca_index

# --- Fixed values: columns of the labels and of the indices ---------------------------------
SOURCE = "source of drinking water"
TIME = "time to get to water source (minutes)"
PLACE = "location of source for water"
SIMPLE = f"{SOURCE} (simplified)"
SCHEME_NAMES = {
    "type": f"{SOURCE} (categorized by type)", "urban": f"{SOURCE} (categorized urban)",
    "piped1": f"{SOURCE} (categorized piped)", "piped2": f"{SOURCE} (categorized piped 2)", "piped3": f"{SOURCE} (categorized piped 3)",
}
CLASS, WEIGHT = f"{SOURCE} (categorized)", f"{SOURCE} (weights)"
FILLED_TIME, FILLED_PLACE = "time to get to water source (refurbished)", f"{PLACE} (refurbished)"
PENALTY, PLACE_WEIGHT = f"{FILLED_TIME} + penalty", "weighting (location)"
BUCKET, BUCKET_RANK = "distance categories", "distance categories num"
INDICES = {
    "cat_distance": [WEIGHT, BUCKET_RANK], "min": [WEIGHT, FILLED_TIME], "w_location_weighting": [WEIGHT, FILLED_TIME, PLACE_WEIGHT],
    "w_penalty": [WEIGHT, PENALTY],
}
# ----------------------------------------------------------------------------------------


def water_households(df: DataFrame) -> DataFrame:
    """Answers simplified, classed and weighted; time and place filled; penalties and distance classes."""
    texts = {k: v for k, v in MINUTE_TEXTS.items() if k != "on premises"}
    minutes = null_tokens(F.col(q(TIME)).cast("string"))
    minutes = F.coalesce(rc.lookup(minutes, {k: f"{v:g}" for k, v in texts.items()}), minutes)
    df = df.withColumns({SIMPLE: rc.simplify_source(null_tokens(q(SOURCE))), TIME: minutes})
    s = F.col(q(SIMPLE))
    df = df.withColumns(
        {
            **{name: rc.source_category(s, scheme) for scheme, name in SCHEME_NAMES.items()},
            CLASS: rc.source_class(s),
            WEIGHT: rc.source_weight(s),
            FILLED_TIME: rc.fetch_time(F.col(q(TIME)), s),
        }
    )
    t = F.col(q(FILLED_TIME))
    df = df.withColumn(FILLED_PLACE, rc.source_location(F.col(q(PLACE)), s, t))
    place = F.col(q(FILLED_PLACE))
    total, capped = rc.with_penalty(t, place)
    label, rank = rc.inclusive_buckets(t, rc.DISTANCE_LIMITS)
    label2, rank2 = rc.inclusive_buckets(t, rc.DISTANCE_LIMITS_SHORT)
    return df.withColumns(
        {
            PLACE_WEIGHT: rc.lookup(place, rc.LOCATION_WEIGHT), PENALTY: total, f"{PENALTY} (capped)": capped,
            BUCKET: label, BUCKET_RANK: rank, f"{BUCKET} 2": label2, f"{BUCKET_RANK} 2": rank2,
        }
    )


def water_indices(df: DataFrame, names: Sequence[str] = tuple(INDICES)) -> DataFrame:
    """First-component indices for urban, rural and all households, rising with the source weight.

    The recoded answers are written once, since every index reads them twice.
    """
    df = cut_lineage(df)
    urban, rural, everyone = F.col("URBAN_RURA") == "U", F.col("URBAN_RURA") == "R", F.lit(True)
    for name in names:
        df = pca_index(df, INDICES[name], WEIGHT, f"PCA {name}", [urban, rural, everyone], ["urban", "rural", "all"])
    return df


def water_clusters(households: DataFrame, locations: DataFrame, numbers: Sequence[str] = (WEIGHT, FILLED_TIME, PLACE_WEIGHT)) -> DataFrame:
    """One row per cluster: means, deviations, households, majority labels with their share, distance class.

    Clusters without a label or a usable position are left out.
    """
    indices = [c for c in households.columns if c.startswith("PCA ")]
    out = mean_and_std(households, ["DHSID"], [*numbers, *indices])
    out = out.join(households.groupBy("DHSID").agg(F.count(F.lit(1)).alias("households")), "DHSID")
    for c in [SIMPLE, *SCHEME_NAMES.values(), CLASS, WEIGHT, FILLED_PLACE]:
        top = majority(households, ["DHSID"], c)
        out = out.join(top.withColumnsRenamed({f"{c}_max": f"{c}: max", f"{c}_perc_max": f"{c}: perc max"}), "DHSID", "left")
    label, _ = rc.inclusive_buckets(F.col(q(FILLED_TIME)), rc.DISTANCE_LIMITS)
    label2, _ = rc.inclusive_buckets(F.col(q(FILLED_TIME)), rc.DISTANCE_LIMITS_SHORT)
    out = out.withColumns({f"{BUCKET} cluster": label, f"{BUCKET} cluster 2": label2})
    placed = out.join(locations, "DHSID", "left")
    return placed.filter(F.col(q(f"{SIMPLE}: max")).isNotNull() & F.col("LATNUM").isNotNull() & ~F.col("LATNUM").between(0.0, 1e-8))
