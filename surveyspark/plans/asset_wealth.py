"""Asset wealth: recoded household goods, index per survey, cluster table and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions import recode as rc
from surveyspark.operators.aggregates import moments_by, period_statistics
from surveyspark.operators.models import component_score, grouped_components, principal_components
from surveyspark.operators.quality import complete_cases

# --- Fixed values: columns of the wealth survey ---------------------------------------------
CODES = {
    "HV001": "CLUSTER", "HV002": "HOUSEHOLD", "HV007": "YEAR", "HV009": "MEMBERS", "HV025": "URBAN_RURAL", "HV201": "WATER_SOURCE",
    "HV205": "TOILET_TYPE", "HV206": "ELECTRICITY", "HV207": "RADIO", "HV208": "TV", "HV209": "FRIDGE", "HV211": "MOTORCYCLE",
    "HV212": "CAR", "HV213": "FLOOR", "HV216": "BEDROOMS", "HV221": "PHONE", "HV243A": "CELLPHONE",
}
FEATURES = [
    "WATER_SOURCE", "TOILET_TYPE", "ELECTRICITY", "RADIO", "TV", "FRIDGE", "MOTORCYCLE", "CAR", "FLOOR", "ROOMSPP", "PHONE", "CELLPHONE",
]
RECODED = ["WATER_SOURCE", "TOILET_TYPE", "FLOOR"]
FIRST_YEAR = 2012
PERIODS = {"2012-2014": (2012, 2014), "2015": (2015, 2015), "2016-2020": (2016, 2020)}
EXTERNAL_NAMES = {
    "cluster": "DHSCLUST", "svyid": "DHSYEAR", "wealth": "WEALTH_INDEX", "cname": "DHSCC", "hv000": "HV000", "year": "SURVEY_YEAR",
    "country": "COUNTRY", "households": "n",
}
# ----------------------------------------------------------------------------------------


def recoded_households(survey: DataFrame, quality: Mapping[str, DataFrame], key: str = "survey") -> DataFrame:
    """Household goods with quality scores for codes; ``quality`` maps a column to its table (code, quality)."""
    have = {c: n for c, n in CODES.items() if c in survey.columns}
    df = survey.withColumnsRenamed(have)
    for c in RECODED:
        table = quality[c].select(F.col("code").cast("double").alias("__code"), F.col("quality").cast("double").alias("__q"))
        df = (
            df.join(table, F.col(c).cast("double") == F.col("__code"), "left")
            .withColumn(c, F.coalesce("__q", F.col(c).cast("double")))
            .drop("__code", "__q")
        )
    df = rc.phone_or_cellphone(df, [key])
    return df.withColumns({"URBAN_RURAL": rc.urban_flag("URBAN_RURAL"), "ROOMSPP": rc.rooms_per_person("BEDROOMS", "MEMBERS")})


def with_wealth_index(households: DataFrame, features: Sequence[str] = FEATURES, surveys: Sequence[str] | None = None, key: str = "survey") -> DataFrame:
    """First component of the standardised goods over complete households.

    With ``surveys`` one index per survey, as before; without, one pooled index that can be
    compared between surveys. Rows keep their keys.
    """
    rows = complete_cases(households, features)
    if surveys is None:
        return rows.withColumn("WEALTH_INDEX", principal_components(rows, features).scores(1)[0])
    found = grouped_components(rows.filter(F.col(key).isin(list(surveys))), features, F.col(key))
    found = found.select(F.col("key").alias("__key"), F.col("mean").alias("__mean"), F.col("std").alias("__std"), F.col("weights").alias("__weights"))
    joined = rows.join(found, F.col(key).cast("string") == F.col("__key"), "left")
    return joined.withColumn("WEALTH_INDEX", component_score(features, "__mean", "__std", "__weights")).drop("__key", "__mean", "__std", "__weights")


def cluster_wealth(households: DataFrame, key: str = "survey") -> DataFrame:
    """Mean index, region type and year per cluster with its number of households."""
    return households.groupBy(key, "CLUSTER").agg(
        F.avg("WEALTH_INDEX").alias("WEALTH_INDEX"), F.avg("URBAN_RURAL").alias("URBAN_RURAL"),
        F.floor(F.avg("YEAR")).cast("int").alias("SURVEY_YEAR"), F.min("HV000").alias("HV000"), F.count(F.lit(1)).alias("n"),
    )


def wealth_locations(clusters: DataFrame, locations: DataFrame, key: str = "survey") -> DataFrame:
    """Cluster index with position; incomplete rows are dropped."""
    loc = locations.withColumn("URBAN_RURA", rc.urban_flag("URBAN_RURA")).withColumn("DHSYEAR", F.col("DHSYEAR").cast("int"))
    joined = loc.join(clusters.withColumnRenamed("CLUSTER", "DHSCLUST"), [key, "DHSCLUST"])
    return joined.dropna()


def external_clusters(table: DataFrame) -> DataFrame:
    """Cluster table of another group in our columns, since the first year used; to be written by (DHSYEAR, COUNTRY)."""
    df = table.dropna().withColumnsRenamed(EXTERNAL_NAMES)
    df = df.withColumns({"DHSYEAR": F.right("DHSYEAR", F.lit(4)).try_cast("int"), "URBAN_RURA": rc.urban_flag("URBAN_RURA")})
    return df.filter(F.col("DHSYEAR") >= FIRST_YEAR).select(
        "DHSCLUST", "DHSYEAR", "WEALTH_INDEX", "HV000", "SURVEY_YEAR", "DHSCC", "COUNTRY", "n", "LATNUM", "LONGNUM", "URBAN_RURA"
    )


def period(year: Column | str) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    out = None
    for name, (a, b) in PERIODS.items():
        out = F.when(y.between(a, b), name) if out is None else out.when(y.between(a, b), name)
    return out


def country_statistics(wealth: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Moments of the index per period and country, and per period over all of them."""
    return period_statistics(wealth.filter(F.col("COUNTRY").isin(list(countries))), "WEALTH_INDEX", period("SURVEY_YEAR"), "COUNTRY")


def region_type_statistics(wealth: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Moments of the index per period and region type."""
    rows = wealth.filter(F.col("COUNTRY").isin(list(countries))).withColumns(
        {"period": period("SURVEY_YEAR"), "ur": F.when(F.col("URBAN_RURA") == 0, "urban").otherwise("rural")}
    )
    return moments_by(rows.filter("period IS NOT NULL"), ["period", "ur"], "WEALTH_INDEX")
