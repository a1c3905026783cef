"""From decoded households to the grouped feature table with phases, education and area indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core import namespaces as ns
from surveyspark.core.bounded import collect_bounded
from surveyspark.core.ordering import melt, with_medians
from surveyspark.functions.calendar import survey_date
from surveyspark.functions.text import as_number, as_text_remainder
from surveyspark.operators.aggregates import (
    frequency_encoding, known, one_hot, weighted_means,
)
from surveyspark.operators.joins import SPANS, interval_aggregate
from surveyspark.operators.quality import completeness

q = ns.quoted

# --- Fixed values: columns that are no questions, artefacts, and the weights of area indices -----
META_COLUMNS = [
    "country code and phase", "GEID", "DHSID", "DHSID + HHID", "version_nr", "subversion_nr", "household number",
    "case identification", "DHSCLUST", "country code", "adm1_gaul", "adm0_gaul", "GEID_init", "month of interview",
    "year of interview", "day of interview", "cluster number", "adm2_gaul", "URBAN_RURA", "survey",
]
NO_NUMBER = ["type of cooking fuel", "language of interview", "owns land usable for agriculture"]
NO_TEXT = ["number of rooms used for sleeping", "hectares of agricultural land (1 decimal)"]
INDEX_WEIGHTS = {
    "asset_index": "n_asset", "water_index": "n_water", "sanitation_index": "n_sanitation",
    "under5_mort": "n_under5_mort", "women_edu": "n_women_edu", "women_bmi": "n_women_bmi",
}
AREA = ["adm0_name", "adm1_name", "adm2_name"]
# --------------------------------------------------------------------------------------------------
MAX_CATEGORIES = 200_000


def located_households(households: DataFrame, locations: DataFrame) -> DataFrame:
    """Households with the areas of their cluster; rows whose cluster numbers disagree are left out."""
    loc = locations.select(
        F.col("GEID").alias("GEID_init"), F.col("TIF_name").alias("GEID"), F.col("adm2_name").alias("adm2_gaul"),
        F.col("adm1_name").alias("adm1_gaul"), F.col("adm0_name").alias("adm0_gaul"), "DHSCLUST", "URBAN_RURA",
    )
    return households.join(loc, "GEID").filter(as_number(F.col("cluster number")) == F.col("DHSCLUST"))


def survey_features(
    located: DataFrame,
    keys: Sequence[str] = ("GEID_init", "adm2_gaul"),
    area: str | None = None,
    hot: Sequence[str] = ("adm0_gaul",),
    frequency: Sequence[str] = ("adm1_gaul", "adm2_gaul"),
) -> DataFrame:
    """One row per survey and area: statistics of the numbers, shares of the answers, encodings and dates.

    Which columns hold numbers and which answers is found in one aggregation, the categories
    in one grouping; medians are joined on.
    """
    keys = list(keys)
    rows = located.filter(" AND ".join(f"`{p} of interview` IS NOT NULL" for p in ("day", "month", "year")))
    for k in keys:
        rows = rows.filter(F.col(q(k)).isNotNull())
    if area in ("U", "R"):
        rows = rows.filter(F.col("URBAN_RURA") == area)
    questions = [c for c in rows.columns if c not in META_COLUMNS]
    stats = completeness(rows, questions)
    nums = [c for c in questions if stats[c]["numbers"] and c not in NO_NUMBER]
    texts = [c for c in questions if stats[c]["known"] > stats[c]["numbers"] and c not in NO_TEXT]

    date = survey_date(*[as_number(F.col(q(f"{p} of interview"))) for p in ("year", "month", "day")])
    base = rows.select(
        *[F.col(q(k)) for k in dict.fromkeys([*keys, "adm0_gaul", "adm1_gaul", "adm2_gaul", "URBAN_RURA", "DHSID + HHID"])],
        F.unix_date(date).cast("double").alias("__date"),
        *[as_number(F.col(q(c))).alias(f"__n{i}") for i, c in enumerate(nums)],
        *[as_text_remainder(F.col(q(c))).alias(f"__t{i}") for i, c in enumerate(texts)],
    ).withColumn(f"__t{len(texts)}", F.col("URBAN_RURA"))
    texts = [*texts, "URBAN_RURA"]
    values = {}
    for c in hot:
        found = base.filter(F.col(c).isNotNull()).select(c).distinct()
        values[c] = sorted(r[0] for r in collect_bounded(found, MAX_CATEGORIES, f"categories of {c}"))
    for c in hot:
        base = one_hot(base, c, values[c])
    for c in frequency:
        base = frequency_encoding(base, c)
    encodings = [c for c in base.columns if c.startswith((ns.ONE_HOT, ns.FREQUENCY))]
    cats = categories(base, [f"__t{i}" for i in range(len(texts))])

    aggs: list[Column] = [F.count(F.lit(1)).alias("Meta; amount of households")]
    for c in ("adm1_gaul", "adm0_gaul", "adm2_gaul"):
        if c not in keys:
            known_id = F.when(F.col(c).isNotNull(), F.col("`DHSID + HHID`"))
            aggs.append(F.min_by(c, known_id).alias(f"Meta; {c}"))
    aggs += [F.avg(F.col(q(c))).alias(c) for c in encodings]
    for i, c in enumerate(nums):
        x = F.col(f"__n{i}")
        stat = {
            "mean": F.avg(x), "std": F.stddev_samp(x), "skewness": known(F.skewness(x)), "kurtosis": known(F.kurtosis(x)),
        }
        aggs += [e.alias(ns.build(ns.NUMERIC, c, s)) for s, e in stat.items()]
        valid = F.count(x) / F.count(F.lit(1)) * 100
        aggs.append(valid.alias(f"Meta; {ns.NUMERIC}; {c}: percentage of valid answers"))
    for i, c in enumerate(texts):
        x = F.col(f"__t{i}")
        for cat in cats.get(f"__t{i}", []):
            share = F.try_divide(F.count(F.when(x == cat, 1)), F.count(x))
            aggs.append(share.alias(ns.build(ns.CATEGORICAL, c, cat)))
        aggs.append((1 - F.count(x) / F.count(F.lit(1))).alias(ns.build(ns.CATEGORICAL, c, "NaN")))

    middle = {"__date": "__date", **{f"__n{i}": ns.build(ns.NUMERIC, c, "median") for i, c in enumerate(nums)}}
    out = with_medians(base.groupBy(*keys).agg(*aggs), base, keys, list(middle), "").withColumnsRenamed(middle)
    when = F.timestamp_seconds(F.col("__date") * 86400)
    out = out.withColumns(
        {"Meta; date": when.cast("date"), "Meta; year": F.year(when), "Meta; month": F.month(when)}
    ).drop("__date")
    return out.withColumnsRenamed({k: f"Meta; {k}" for k in keys})


def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Answers that occur in each column, in order; the number of distinct answers is checked."""
    found = melt(df, [], cols, "string").filter(F.col("value").isNotNull()).distinct()
    out: dict[str, list[str]] = {}
    for r in collect_bounded(found, MAX_CATEGORIES, "distinct answers"):
        out.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def _meta_keys(features: DataFrame, with_year: bool) -> tuple[DataFrame, list[str]]:
    """Features with plain join keys beside the grammar names."""
    names = {"__adm0": "Meta; adm0_gaul", "__adm1": "Meta; adm1_gaul", "__adm2": "Meta; adm2_gaul"}
    if with_year:
        names["__year"] = "Meta; year"
    return features.withColumns({k: F.col(q(v)) for k, v in names.items()}), list(names)


def add_phases(features: DataFrame, panel: DataFrame, spans: Sequence[tuple[int, int, str]] = SPANS) -> DataFrame:
    """Food-security phases around the median interview date of each row."""
    keyed, keys = _meta_keys(features, False)
    months = panel.select(
        *[F.col(a).alias(k) for a, k in zip(AREA, keys)], F.make_date("year", "month", F.lit(1)).alias("__m"), "IPC", "IPC + food help"
    )
    out = interval_aggregate(
        keyed, months, keys, "Meta; date", "__m", {"IPC": "IPC", "IPC + food help": "IPC + FH"}, spans
    )
    return out.drop(*keys)


def _attach(features: DataFrame, table: DataFrame, year: str, dataset: str) -> DataFrame:
    keyed, keys = _meta_keys(features, True)
    cols = [c for c in table.columns if c not in (*AREA, year)]
    right = table.select(
        *[F.col(a).alias(k) for a, k in zip([*AREA, year], keys)], *[F.col(q(c)).alias(ns.build(dataset, c)) for c in cols]
    )
    return keyed.join(right, keys, "left").drop(*keys)


def add_education(features: DataFrame, education: DataFrame, cols: Sequence[str], year: str = "DHSYEAR") -> DataFrame:
    """Area means of education columns that are not imputed."""
    own = education.filter(~F.col("Imputed"))
    means = own.groupBy(*AREA, year).agg(*[F.avg(F.col(q(c))).alias(c) for c in cols])
    return _attach(features, means, year, ns.EDUCATION)


def add_area_indices(features: DataFrame, index: DataFrame, year: str = "year") -> DataFrame:
    """Area means of the index columns, each weighted by its own number of households; one gap empties a mean."""
    have = {c: w for c, w in INDEX_WEIGHTS.items() if c in index.columns}
    return _attach(features, weighted_means(index, [*AREA, year], have, poison=True), year, ns.SUSTAIN)
