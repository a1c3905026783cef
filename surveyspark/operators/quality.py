"""Column and row selection, completeness, validity and uniqueness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.core import namespaces as ns
from surveyspark.functions.text import as_number, as_text_remainder, null_tokens

q = ns.quoted


def clean_null_tokens(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: null_tokens(F.col(q(c))) for c in cols})


def conversion_failures(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values that are present but are no numbers: keys, column, value."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("value")) for c in cols]))
    long = df.select(*keys, kv.alias("kv")).select(*keys, "kv.column", "kv.value")
    return long.filter(null_tokens("value").isNotNull() & as_number("value").isNull())


def completeness(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, int]]:
    """Per column: rows, known values, numbers and texts, from one aggregation."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        col = F.col(q(c))
        aggs.append(F.count(col).alias(f"k{i}"))
        aggs.append(F.count(as_number(col)).alias(f"n{i}"))
    r = df.agg(*aggs).first()
    return {c: {"rows": r["rows"], "known": r[f"k{i}"], "numbers": r[f"n{i}"]} for i, c in enumerate(cols)}


def known_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows and non-null values per column in one pass."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r["rows"], {c: r[f"c{i}"] for i, c in enumerate(cols)}


def split_mixed(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    no_number: Sequence[str] = (),
    no_text: Sequence[str] = (),
) -> DataFrame:
    """Numeric part ``DHS Num; c`` and text part ``DHS Cat; c`` of every column that has one.

    ``no_number`` / ``no_text`` name columns whose numbers or texts are artefacts.
    """
    stats = completeness(df, cols)
    out: list[Column] = [F.col(q(k)) for k in keys]
    for c in cols:
        s, col = stats[c], F.col(q(c))
        if s["numbers"] > 0 and c not in no_number:
            out.append(as_number(col).alias(ns.build(ns.NUMERIC, c)))
        if s["known"] > s["numbers"] and c not in no_text:
            out.append(as_text_remainder(col).alias(ns.build(ns.CATEGORICAL, c)))
    return df.select(*out)


def numbered_names(names: Sequence[str], max_copies: int | None = None) -> tuple[list[str], list[str]]:
    """Names with repeats numbered ``_Nr2``, ``_Nr3``…, and the names beyond ``max_copies``."""
    seen: Counter[str] = Counter()
    new, surplus = [], []
    for name in names:
        seen[name] += 1
        renamed = name if seen[name] == 1 else f"{name}_Nr{seen[name]}"
        new.append(renamed)
        if max_copies and seen[name] > max_copies:
            surplus.append(renamed)
    return new, surplus


def number_duplicate_columns(df: DataFrame, max_copies: int | None = None) -> DataFrame:
    names, surplus = numbered_names(df.columns, max_copies)
    return df.toDF(*names).drop(*surplus)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    _, known = known_counts(df, df.columns)
    return df.select(*[F.col(q(c)) for c in df.columns if known[c] > 0])


def drop_sparse_columns(df: DataFrame, percent: float, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns known in less than ``percent`` of the rows; names holding a ``keep`` part stay."""
    rows, known = known_counts(df, df.columns)
    if rows == 0:
        return df
    stay = [c for c in df.columns if known[c] / rows * 100 >= percent or any(k in c for k in keep)]
    return df.select(*[F.col(q(c)) for c in stay])


def redundant_categories(names: Sequence[str], known: Mapping[str, int], single: bool = True, pairs: bool = True) -> list[str]:
    """Category columns that repeat what another column or none at all says.

    The only category of a question goes; of two the less complete one goes, at a tie
    ``no`` or ``not applicable``, else the second.
    """
    by_question: dict[str, list[str]] = {}
    for name in names:
        f = ns.parse(name)
        if f.dataset == ns.CATEGORICAL and f.stat is not None and f.stat != "NaN":
            by_question.setdefault(name.rsplit(": ", 1)[0], []).append(f.stat)
    drop = []
    for base, stats in by_question.items():
        if len(stats) == 1 and single:
            drop.append(f"{base}: {stats[0]}")
        elif len(stats) == 2 and pairs:
            first, second = (f"{base}: {s}" for s in stats)
            if known[first] > known[second]:
                drop.append(second)
            elif known[first] < known[second]:
                drop.append(first)
            elif set(stats) == {"yes", "no"}:
                drop.append(f"{base}: no")
            elif set(stats) == {"applicable", "not applicable"}:
                drop.append(f"{base}: not applicable")
            else:
                drop.append(second)
    return drop


def drop_redundant_categories(df: DataFrame, single: bool = True, pairs: bool = True) -> DataFrame:
    cats = [c for c in df.columns if ns.parse(c).dataset == ns.CATEGORICAL]
    if not cats:
        return df
    _, known = known_counts(df, cats)
    gone = set(redundant_categories(cats, known, single, pairs))
    return df.select(*[F.col(q(c)) for c in df.columns if c not in gone])


# --- Fixed values: spans of the food-security columns and farm questions ------------------
FINE_SPANS = ["0-5m", "6-12m", "1-2y", "2-4y", "4-6y", "6-7y", "6-10y", "10-15y", "15-20y", "20-25y"]
WIDE_SPANS = ["0-1y", "0-2y", "2-6y", "6-12y", "12-20y"]
FARM_QUESTIONS = [
    "owns rabbits", "hectares of agricultural land (1 decimal)", "owns goats", "owns horses/ donkeys/ mules",
    "owns cows/ bulls", "owns chickens/poultry", "sewing machine", "owns land usable for agriculture",
    "owns sheep", "owns livestock, herds or farm animals",
]
LANGUAGE_QUESTIONS = ["language of interview", "native language", "language of questionnaire"]
AREA_COLUMNS = ["adm0_gaul", "adm1_gaul", "adm2_gaul"]
# ----------------------------------------------------------------------------------------


@dataclass
class FeatureOptions:
    """Switches of the feature-table selection."""

    drop_meta: bool = False
    drop_spans: Sequence[str] = ("6-7y", "20-25y", "0-1y")
    drop_food_help: bool = True
    drop_phase_without_help: bool = False
    min_percent: float | None = 75
    drop_region: bool = True
    drop_languages: Sequence[str] = field(default_factory=lambda: list(LANGUAGE_QUESTIONS))
    phase_stat: str | None = "mean"
    keep_spans: str | None = "wide"  # "wide", "fine" or None for both
    numeric_stats: Sequence[str] = ("mean", "std", "skewness", "kurtosis")
    fill_categories: bool = False
    keep_year: bool = True
    keep_month: bool = True
    keep_areas: Sequence[str] = field(default_factory=lambda: list(AREA_COLUMNS))
    keep_survey: bool = False
    keep_valid_percent: bool = False
    drop_single_categories: bool = True
    drop_one_of_two_categories: bool = True
    drop_correlated_above: float | None = None
    drop_datasets: Sequence[str] = ()
    only_datasets: Sequence[str] = ()
    drop_farm: bool = False
    min_version: int | None = None
    keep_fold_columns: bool = True
    numeric_type: str | None = "float"


def feature_names(names: Sequence[str], o: FeatureOptions) -> list[str]:
    """The part of the selection that looks at names only."""
    datasets = {n.split(";", 1)[0] for n in names}
    gone_sets = set(o.drop_datasets)
    if o.only_datasets:
        gone_sets = datasets - set(o.only_datasets)
        if gone_sets == datasets:
            raise ValueError(f"no dataset left: {list(o.only_datasets)}")

    keep_parts = list(o.keep_areas)
    keep_parts += ["year"] if o.keep_year or o.keep_fold_columns else []
    keep_parts += ["month"] if o.keep_month else []
    keep_parts += ["GEID_init"] if o.keep_survey or o.keep_fold_columns else []
    keep_parts += ["percentage of valid answers"] if o.keep_valid_percent else []
    keep_parts += ["adm0_gaul"] if o.keep_fold_columns else []
    without_meta = o.drop_meta or ns.META in gone_sets

    def stays(n: str) -> bool:
        is_meta = n.startswith(f"{ns.META}; ")
        is_phase = n.startswith(f"{ns.FOOD_SECURITY}; IPC")
        if is_meta and without_meta and not any(p in n for p in keep_parts):
            return False
        if not is_meta and any(f"{d};" in n for d in gone_sets):
            return False
        if is_phase and any(s in n for s in o.drop_spans):
            return False
        if o.drop_food_help and f"{ns.FOOD_SECURITY}; IPC + FH:" in n:
            return False
        if o.drop_phase_without_help and f"{ns.FOOD_SECURITY}; IPC:" in n:
            return False
        if not o.fill_categories and n.startswith(f"{ns.CATEGORICAL};") and ": NaN" in n:
            return False
        if o.drop_region and n.startswith(f"{ns.CATEGORICAL}; region:"):
            return False
        if any(lang in n for lang in o.drop_languages):
            return False
        if is_phase and o.phase_stat and o.phase_stat not in n:
            return False
        if is_phase and o.keep_spans == "wide" and any(s in n for s in FINE_SPANS):
            return False
        if is_phase and o.keep_spans == "fine" and any(s in n for s in WIDE_SPANS):
            return False
        if n.startswith(f"{ns.NUMERIC};") and o.numeric_stats and not any(s in n for s in o.numeric_stats):
            return False
        if o.drop_farm and any(f in n for f in FARM_QUESTIONS):
            return False
        return n != "index"

    return [n for n in names if stays(n)]


def select_features(df: DataFrame, o: FeatureOptions | None = None) -> DataFrame:
    """Select feature columns by the name grammar, completeness and redundancy."""
    o = o or FeatureOptions()
    if o.min_version is not None:
        df = df.filter(F.substring(F.col(q("Meta; GEID_init")), 5, 1).try_cast("int") >= o.min_version)
    df = df.select(*[F.col(q(c)) for c in feature_names(df.columns, o)])
    if o.fill_categories:
        cats = [c for c in df.columns if c.startswith(f"{ns.CATEGORICAL};")]
        df = df.withColumns({c: F.coalesce(F.col(q(c)), F.lit(0.0)) for c in cats})
    if o.min_percent:
        df = drop_sparse_columns(df, o.min_percent, keep=[f"{ns.FOOD_SECURITY}; IPC"])
    if o.drop_single_categories or o.drop_one_of_two_categories:
        df = drop_redundant_categories(df, o.drop_single_categories, o.drop_one_of_two_categories)
    if o.drop_correlated_above is not None:
        df = drop_correlated(df, o.drop_correlated_above)
    if o.numeric_type:
        nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        df = df.withColumns({c: F.col(q(c)).cast(o.numeric_type) for c in nums})
    return df


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation in long form: a, b, n, corr (a before b).

    Every partition adds up masked cross products as matrices; the small matrices are
    summed by Spark. Values are shifted by the column mean first, for accuracy.
    """
    cols = list(cols)
    k = len(cols)
    names = [f"c{i}" for i in range(k)]
    shift = df.agg(F.array(*[F.coalesce(F.avg(F.col(q(c)).cast("double")), F.lit(0.0)) for c in cols]).alias("m")).scalar()
    data = df.select(*[(F.col(q(c)).cast("double") - shift[i]).alias(names[i]) for i, c in enumerate(cols)])

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((5, k, k))
        for pdf in parts:
            x = pdf.to_numpy(dtype=float)
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            acc += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x, m.T @ x])
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame(
            {
                "i": i, "j": j, "n": acc[0][i, j], "sx": acc[1][i, j], "sy": acc[4][i, j],
                "sxx": acc[2][i, j], "syy": acc[2][j, i], "sxy": acc[3][i, j],
            }
        )

    sums = (
        data.mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    labels = F.array(*[F.lit(c) for c in cols])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.when(n > 0, n)
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.when(n > 0, n)
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.when(n > 0, n)
    corr = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return sums.select(
        labels[F.col("i")].alias("a"), labels[F.col("j")].alias("b"), n.cast("bigint").alias("n"), corr.alias("corr")
    )


def correlated_columns(cols: Sequence[str], corr: Mapping[tuple[str, str], float], known: Mapping[str, int], above: float) -> list[str]:
    """Columns to drop: of a column and the later ones correlated with it, all but the most complete."""
    drop: list[str] = []
    for i, a in enumerate(cols):
        group = [b for b in cols[i + 1 :] if (corr.get((a, b)) or 0.0) > above]
        if group:
            members = [a, *group]
            keep = max(members, key=lambda c: (known[c], -members.index(c)))
            drop += [c for c in members if c != keep and c not in drop]
    return drop


def drop_correlated(df: DataFrame, above: float) -> DataFrame:
    nums = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and not f.name.startswith(ns.META)
        and not (f.name.startswith(f"{ns.NUMERIC};") and f.name.endswith("median"))
    ]
    if len(nums) < 2:
        return df
    _, known = known_counts(df, nums)
    pairs = {(r["a"], r["b"]): abs(r["corr"]) for r in correlation_pairs(df, nums).collect() if r["corr"] is not None}
    gone = set(correlated_columns(nums, pairs, known, above))
    return df.select(*[F.col(q(c)) for c in df.columns if c not in gone])


def restrict_sample(
    df: DataFrame,
    since_year: int | None = None,
    area: str | None = None,
    tiles: DataFrame | None = None,
    drop_surveys: Sequence[str] = (),
) -> DataFrame:
    """Rows of the wanted years, region type, with a tile on file, without dropped surveys."""
    if since_year:
        df = df.filter(F.col("DHSYEAR") >= since_year)
    if area not in (None, "all", "urban", "rural"):
        raise ValueError(f"unknown area type {area}")
    if area in ("urban", "rural"):
        df = df.filter(F.col("URBAN_RURA") == area[0].upper())
    if drop_surveys:
        df = df.filter(~F.col("GEID").isin(list(drop_surveys)))
    if tiles is not None:
        df = df.join(tiles.select("TIF_name").distinct(), "TIF_name", "left_semi")
    return df


def moments_of(df: DataFrame, col: str) -> Column:
    """Mean and sample deviation of a whole column as a scalar struct (m, s)."""
    return df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).alias("ms")).scalar()


def drop_outlier_groups(df: DataFrame, group: str, value: str, k: float = 1.0) -> DataFrame:
    """Drop groups whose mean is more than ``k`` overall deviations from the overall mean."""
    ms = moments_of(df, value)
    means = df.groupBy(group).agg(F.avg(value).alias("__gm"))
    outside = means.filter((F.col("__gm") > ms["m"] + k * ms["s"]) | (F.col("__gm") < ms["m"] - k * ms["s"]))
    return df.join(outside.select(group), group, "left_anti")


def trim_sigma(df: DataFrame, value: str, low: float | None = 3.5, high: float | None = 3.5) -> DataFrame:
    """Rows inside mean ± k deviations, per side."""
    ms = moments_of(df, value)
    keep = F.col(value).isNotNull()
    if high is not None:
        keep = keep & (F.col(value) <= ms["m"] + high * ms["s"])
    if low is not None:
        keep = keep & (F.col(value) >= ms["m"] - low * ms["s"])
    return df.filter(keep)


def clip_sigma(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values beyond mean ± k deviations set to the bound, per side."""
    ms = moments_of(df, value)
    c = F.col(value).cast("double")
    out = c
    if high is not None:
        out = F.when(c >= ms["m"] + high * ms["s"], ms["m"] + high * ms["s"]).otherwise(out)
    if low is not None:
        out = F.when(c <= ms["m"] - low * ms["s"], ms["m"] - low * ms["s"]).otherwise(out)
    return df.withColumn(value, out)


def prefix_columns(df: DataFrame, dataset: str, skip: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: ns.build(dataset, c) for c in df.columns if c not in skip and not c.startswith(dataset)})


def cluster_id(survey: Column | str, cluster: Column | str) -> Column:
    s = F.col(survey) if isinstance(survey, str) else survey
    c = F.col(cluster) if isinstance(cluster, str) else cluster
    return F.concat(s, zero_fill(c, 8))


def zero_fill(number: Column, width: int) -> Column:
    """Zero-padded text that never cuts longer numbers."""
    text = number.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def household_id(survey: Column | str, cluster: Column | str, household: Column | str) -> Column:
    h = F.col(household) if isinstance(household, str) else household
    return F.concat(cluster_id(survey, cluster), zero_fill(h, 8))


def year_cluster_id(country: Column, year: Column, cluster: Column) -> Column:
    """Country, survey year and cluster number: the id used by location tables."""
    return F.concat(country, year.cast("int").cast("string"), zero_fill(cluster, 8))


def external_id(country: Column, year: Column, version: Column, cluster: Column) -> Column:
    """Id of the external index table: ``CC-year-version#-cluster``."""
    return F.concat(F.concat_ws("-", country, year.cast("int").cast("string"), version), F.lit("#-"), zero_fill(cluster, 8))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; running the plan fails when a key occurs twice."""
    worst = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).scalar()
    ok = F.when(worst > 1, F.raise_error(F.lit(f"duplicate key {list(keys)}")).cast("boolean")).otherwise(F.lit(True))
    return df.filter(ok)


def ids_in_several(df: DataFrame, ident: str, source: str) -> DataFrame:
    """Ids that occur in more than one source."""
    return df.groupBy(ident).agg(F.countDistinct(source).alias("sources")).filter("sources > 1")


def split_by_coordinates(
    df: DataFrame, lat: str = "LATNUM", lon: str = "LONGNUM", lat2: str | None = None, lon2: str | None = None, tolerance: float = 0.01
) -> DataFrame:
    """Column ``reject`` names why a location is unusable: missing position or two positions that differ."""
    zero = (F.col(lat) == 0) | (F.col(lon) == 0) | F.col(lat).isNull() | F.col(lon).isNull()
    reason = F.when(zero, "no position")
    if lat2 and lon2:
        apart = (F.abs(F.col(lat) - F.col(lat2)) >= tolerance) | (F.abs(F.col(lon) - F.col(lon2)) >= tolerance)
        reason = reason.when(apart, "positions differ")
    return df.withColumn("reject", reason)


def unify_columns(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One column per group: first known value in the given order; the other columns go."""
    for target, members in groups.items():
        value = F.coalesce(*[F.col(q(m)) for m in members])
        df = df.withColumn("__unified", value).drop(*members).withColumnRenamed("__unified", target)
    return df


def order_by_availability(df: DataFrame, members: Sequence[str]) -> list[str]:
    """Members from the most to the least complete; ties in the given order."""
    _, known = known_counts(df, members)
    return sorted(members, key=lambda m: (-known[m], list(members).index(m)))


def repair_areas(df: DataFrame, country_names: Mapping[str, str], levels: Sequence[str] = ("adm0_name", "adm1_name", "adm2_name")) -> DataFrame:
    """Fill area names from the buffered layer (``…_``), rename countries, let the country win."""
    country = F.col("country")
    for old, new in country_names.items():
        country = F.when(F.col("country") == old, F.lit(new)).otherwise(country)
    df = df.withColumns({a: F.coalesce(F.col(a), F.col(f"{a}_")) for a in levels if f"{a}_" in df.columns})
    df = df.withColumn("country", country)
    top = levels[0]
    wrong = F.col(top).isNull() | (F.col("country") != F.col(top))
    return df.withColumn(top, F.when(wrong & F.col("country").isNotNull(), F.col("country")).otherwise(F.col(top)))


def complete_cases(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(required))


def missing_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per required column the rows dropped because of it, and rows complete in all."""
    any_missing = F.lit(False)
    for c in required:
        any_missing = any_missing | F.col(q(c)).isNull()
    items = [F.struct(F.lit(c).alias("column"), F.col(q(c)).isNull().alias("missing")) for c in required]
    items.append(F.struct(F.lit("any").alias("column"), any_missing.alias("missing")))
    return (
        df.select(F.explode(F.array(*items)).alias("i"))
        .groupBy("i.column")
        .agg(F.sum(F.col("i.missing").cast("bigint")).alias("missing"), F.count(F.lit(1)).alias("rows"))
    )


def mixed_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns holding both numbers and texts: column, numbers, texts."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("v")) for c in cols]))
    return (
        df.select(kv.alias("kv"))
        .groupBy("kv.column")
        .agg(F.count(as_number("kv.v")).alias("numbers"), F.count(as_text_remainder("kv.v")).alias("texts"))
        .filter("numbers > 0 AND texts > 0")
    )


def missing_inputs(labels: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Labels without a file."""
    return labels.join(files.select(key).distinct(), key, "left_anti")


def prepare_panel(df: DataFrame, phase: str = "CS", help_: str = "HA0") -> DataFrame:
    """Monthly panel with phase and phase plus food help; unknown help counts as none."""
    help_value = F.coalesce(F.col(help_), F.lit(0))
    return df.select(
        "adm2_name", "adm1_name", "adm0_name", "month", "year",
        F.col(phase).cast("double").alias("IPC"),
        (F.col(phase) + help_value).cast("double").alias("IPC + food help"),
    )


def relabel_periods(col: Column | str) -> Column:
    """``2012_2014`` to ``2012-2014``, a period of one year to that year."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(c, "_", "-"), r"\b([0-9]{4})-\1\b", "$1")
