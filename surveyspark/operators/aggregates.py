"""Group statistics, shares, crosstabs, profiles and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core.stats import correlation
from surveyspark.core import namespaces as ns
from surveyspark.core.ordering import average_ranks, melt, with_medians
from surveyspark.functions.text import answer_text, as_number

q = ns.quoted


def _not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(q(k)).isNotNull())
    return df


def sample_skewness(c: Column | str) -> Column:
    """Bias-corrected skewness (needs three values and some spread)."""
    n = F.count(c)
    g1 = F.skewness(c)
    return F.when((n > 2) & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis (needs four values and some spread)."""
    n = F.count(c)
    g2 = F.kurtosis(c)
    return F.when((n > 3) & ~F.isnan(g2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def statistic_bundle(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], firsts: Mapping[str, str] | None = None
) -> DataFrame:
    """Mean, median, std, skewness, kurtosis, % valid of every column, group size, and first known values.

    ``firsts`` maps a column to the column that orders it. Skewness and kurtosis are the
    population forms. Column names are ``<col>_<stat>``.
    """
    df = _not_null(df, keys)
    return _with_medians(df, keys, cols, _bundle(cols, firsts))


def _bundle(cols: Sequence[str], firsts: Mapping[str, str] | None) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("households")]
    for c in cols:
        x = F.col(q(c)).cast("double")
        aggs += [
            F.avg(x).alias(f"{c}_mean"),
            F.stddev_samp(x).alias(f"{c}_std"),
            known(F.skewness(x)).alias(f"{c}_skewness"),
            known(F.kurtosis(x)).alias(f"{c}_kurtosis"),
            (F.count(x) / F.count(F.lit(1)) * 100).alias(f"{c}_valid_percent"),
        ]
    for c, order in (firsts or {}).items():
        aggs.append(first_known(c, order).alias(c))
    return aggs


def _with_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], aggs: list[Column], suffix: str = "_median") -> DataFrame:
    """Aggregates with exact medians joined on."""
    return with_medians(df.groupBy(*keys).agg(*aggs), df, keys, cols, suffix)


def first_known(col: str, order: str) -> Column:
    """First non-null value along an order column, the same on every run."""
    return F.min_by(F.col(q(col)), F.when(F.col(q(col)).isNotNull(), F.col(q(order))))


def category_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ) -> DataFrame:
    """Long counts: keys, column, category (null category = missing answers), n."""
    long = melt(_not_null(df, keys), keys, cols, "string")
    return long.groupBy(*keys, "column", F.col("value").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def category_shares(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Share of each category among known answers, and of missing answers (``NaN``) among all.

    Long form: keys, column, category, share. The window runs over the counts, one row
    per category, never over the data.
    """
    counts = category_counts(df, keys, cols)
    totals = counts.groupBy(*keys, "column").agg(
        F.sum("n").alias("__all"), F.sum(F.when(F.col("category").isNotNull(), F.col("n")).otherwise(0)).alias("__known")
    )
    known_shares = (
        counts.filter("category IS NOT NULL")
        .join(totals, [*keys, "column"])
        .select(*keys, "column", "category", (F.col("n") / F.col("__known")).alias("share"))
    )
    missing = totals.select(
        *keys, "column", F.lit("NaN").alias("category"), ((F.col("__all") - F.col("__known")) / F.col("__all")).alias("share")
    )
    return known_shares.unionByName(missing)


def shares_wide(
    shares: DataFrame, keys: Sequence[str], categories: Mapping[str, Sequence[str]], namer=None
) -> DataFrame:
    """Wide shares with given categories; absent categories are 0 where the group has answers, else null."""
    namer = namer or (lambda c, k: ns.build(ns.CATEGORICAL, c, k))
    aggs = []
    for c, cats in categories.items():
        is_col = F.col("column") == c
        nan_share = F.max(F.when(is_col & (F.col("category") == "NaN"), F.col("share")))
        for cat in cats:
            share = F.max(F.when(is_col & (F.col("category") == cat), F.col("share")))
            aggs.append(F.when(nan_share < 1, F.coalesce(share, F.lit(0.0))).alias(namer(c, cat)))
        aggs.append(nan_share.alias(namer(c, "NaN")))
    return shares.groupBy(*keys).agg(*aggs)


def share_columns(categories: Mapping[str, Sequence[str]], namer=None) -> list[Column]:
    """Aggregates for the shares of given categories: over known answers, and of missing ones over all.

    For a fixed list of categories this needs no long form: everything is one grouping.
    """
    namer = namer or (lambda c, k: ns.build(ns.CATEGORICAL, c, k))
    out = []
    for c, cats in categories.items():
        x = F.col(q(c))
        for cat in cats:
            out.append(F.try_divide(F.count(F.when(x == cat, 1)), F.count(x)).alias(namer(c, cat)))
        out.append((1 - F.count(x) / F.count(F.lit(1))).alias(namer(c, "NaN")))
    return out


def grouped_feature_table(
    df: DataFrame, keys: Sequence[str], nums: Sequence[str], categories: Mapping[str, Sequence[str]],
    firsts: Mapping[str, str] | None = None, namer=None,
) -> DataFrame:
    """Statistic bundle of the numbers and shares of the categories."""
    df = _not_null(df, keys)
    return _with_medians(df, keys, nums, [*_bundle(nums, firsts), *share_columns(categories, namer)])


def counts_wide(df: DataFrame, keys: Sequence[str], col: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One count column per category, 0 where absent."""
    prefix = f"{col}: " if prefix is None else prefix
    return _not_null(df, keys).groupBy(*keys).agg(
        *[F.sum(F.when(F.col(q(col)) == c, 1).otherwise(0)).alias(f"{prefix}{c}") for c in categories]
    )


def majority(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent category (ties: first in alphabetical order) and its share in percent."""
    counts = category_counts(df, keys, [col]).filter("category IS NOT NULL")
    return counts.groupBy(*keys).agg(
        F.min_by("category", F.struct((-F.col("n")).alias("n"), F.col("category"))).alias(f"{col}_max"),
        (F.max("n") / F.sum("n") * 100).alias(f"{col}_perc_max"),
    )


def majority_of_columns(cols: Sequence[str]) -> Column:
    """Name of the column with the largest count; ties take the earlier column, nulls count as 0."""
    best = F.greatest(*[F.coalesce(F.col(q(c)), F.lit(0)) for c in cols])
    chain = None
    for c in cols:
        hit = F.coalesce(F.col(q(c)), F.lit(0)) == best
        chain = F.when(hit, F.lit(c)) if chain is None else chain.when(hit, F.lit(c))
    return chain


def survey_crosstab(
    df: DataFrame, keys: Sequence[str], source: str, categories: Sequence[str], year: str, residence: str
) -> DataFrame:
    """Counts per source and group with the most frequent year and residence of the group."""
    wide = counts_wide(df.filter(F.col(q(source)).isNotNull()), keys, source, categories, prefix="")
    years = majority(df, keys, year).select(*keys, F.col(f"{year}_max").alias("year"))
    homes = majority(df, keys, residence).select(*keys, F.col(f"{residence}_max").alias("residence"))
    return wide.join(years, list(keys), "left").join(homes, list(keys), "left")


def mean_and_std(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _not_null(df, keys).groupBy(*keys).agg(
        *[F.avg(q(c)).alias(c) for c in cols],
        *[F.stddev_samp(q(c)).alias(f"Std Deviation: {c}") for c in cols],
    )


def weighted_mean(x: Column, w: Column, poison: bool = False) -> Column:
    """Sum of x·w over sum of w; with ``poison`` one missing value makes the whole mean missing."""
    both = x.isNotNull() & w.isNotNull()
    mean = F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))
    if poison:
        return F.when(F.count(F.when(both, 1)) == F.count(F.lit(1)), mean)
    return mean


def weighted_std(x: Column, w: Column) -> Column:
    return F.sqrt(weighted_variance(x, w))


def weighted_variance(x: Column, w: Column) -> Column:
    """Variance around the weighted mean, from central moments around the plain mean ``m``.

    ``cov(w·x, x) - m·cov(w, x)`` is the mean of ``w·(x - m)²`` and ``cov(w, x) / mean(w)`` the
    distance of both means, so squares of a large offset are never subtracted. Null without weight.
    """
    x = F.when(x.isNotNull() & w.isNotNull(), x)
    w = F.when(x.isNotNull(), w)
    mean_w = F.nullif(F.avg(w), F.lit(0.0))
    tilt = F.covar_pop(w, x)
    variance = (F.covar_pop(w * x, x) - F.avg(x) * tilt) / mean_w - F.pow(tilt / mean_w, 2)
    return F.when(variance.isNotNull(), F.greatest(variance, F.lit(0.0)))


def weighted_means(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, str], poison: bool = False) -> DataFrame:
    """Per group the mean of every column weighted by its own weight column."""
    return _not_null(df, keys).groupBy(*keys).agg(
        *[weighted_mean(F.col(q(c)).cast("double"), F.col(q(w)).cast("double"), poison).alias(c) for c, w in pairs.items()]
    )


def value_counts(df: DataFrame, cols: Sequence[str], normalise: bool = False, drop_nulls: bool = False) -> DataFrame:
    """Rows per combination of values; as a share of all rows when ``normalise``."""
    src = _not_null(df, cols) if drop_nulls else df
    counts = src.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    if not normalise:
        return counts
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def profile_columns(
    df: DataFrame,
    cols: Sequence[str],
    version: str,
    survey: str,
    since_version: int = 7,
    min_percent: float = 0.2,
) -> DataFrame:
    """One row per column: availability, numbers, texts, range, moments, and availability over surveys.

    The data is read once into (column, survey, version) partial sums; everything else is
    computed from these.
    """
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("v")) for c in cols]))
    long = df.select(F.col(q(version)).alias("__ver"), F.col(q(survey)).alias("__sur"), items.alias("kv"))
    num = as_number(F.col("kv.v"))
    known_v = F.col("kv.v").isNotNull()
    part = long.groupBy(F.col("kv.column").alias("column"), "__sur", "__ver").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("kv.v").alias("known"),
        F.count(num).alias("nums"),
        F.count(F.when(known_v & num.isNull(), 1)).alias("texts"),
        F.sum(num).alias("sx"),
        F.var_pop(num).alias("vp"),
        F.min(num).alias("mn"),
        F.max(num).alias("mx"),
    )
    distinct_numbers = (
        long.filter(num.isNotNull()).select(F.col("kv.column").alias("column"), num.alias("x")).distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("unique_numbers"))
    )
    surveys = part.groupBy("column", "__sur").agg(F.sum("known").alias("k"), F.sum("rows").alias("r")).groupBy("column").agg(
        (F.count(F.when(F.col("k") > 0, 1)) / F.count(F.lit(1)) * 100).alias("surveys_with_data_percent"),
        F.avg(F.when(F.col("k") > 0, F.col("k") / F.col("r") * 100)).alias("mean_percent_in_surveys_with_data"),
    )
    recent = F.col("__ver") >= since_version
    total = part.groupBy("column").agg(
        F.sum("known").alias("available"),
        (F.sum("known") / F.sum("rows") * 100).alias("available_percent"),
        F.sum(F.when(recent, F.col("known"))).alias("available_recent"),
        (F.sum(F.when(recent, F.col("known"))) / F.sum(F.when(recent, F.col("rows"))) * 100).alias("available_recent_percent"),
        (F.sum("nums") / F.sum("rows") * 100).alias("numeric_percent"),
        (F.sum("texts") / F.sum("rows") * 100).alias("string_percent"),
        F.min("mn").alias("min"),
        F.max("mx").alias("max"),
        F.sum("nums").alias("__n"),
        F.sum("sx").alias("__sx"),
        F.sum(F.col("nums") * F.col("vp") + F.when(F.col("nums") > 0, F.col("sx") * F.col("sx") / F.col("nums"))).alias("__sxx"),
    )
    n, sx, sxx = F.col("__n"), F.col("__sx"), F.col("__sxx")
    out = total.join(surveys, "column").join(distinct_numbers, "column", "left")
    return out.filter(F.col("available_percent") > min_percent).select(
        "column",
        "available",
        "available_percent",
        "available_recent",
        "available_recent_percent",
        "surveys_with_data_percent",
        "mean_percent_in_surveys_with_data",
        "numeric_percent",
        "string_percent",
        F.coalesce("unique_numbers", F.lit(0)).alias("unique_numbers"),
        "min",
        "max",
        F.when(n > 0, sx / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(sxx - sx * sx / n, F.lit(0.0)) / (n - 1))).alias("std"),
        F.when((F.col("numeric_percent") > 0) & (F.col("string_percent") > 0), "mixed")
        .when(F.col("numeric_percent") > 0, "numeric")
        .otherwise("categorical")
        .alias("data_type"),
    )


def availability_by_version(df: DataFrame, cols: Sequence[str], version: str) -> DataFrame:
    """Known answers per column and version: amount and percent."""
    long = melt(df, [version], cols, "string")
    return long.groupBy("column", version).agg(
        F.count("value").alias("available"), (F.count("value") / F.count(F.lit(1)) * 100).alias("available_percent")
    )


def answer_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of every text answer among the text answers of its column, key and answer apart merged."""
    long = melt(df, [], cols, "string").filter(F.col("value").isNotNull() & as_number("value").isNull())
    counts = long.groupBy("column", answer_text("value").alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("__t"))
    return counts.join(totals, "column").select("column", "answer", "n", (F.col("n") / F.col("__t") * 100).alias("percent"))


def period_statistics(df: DataFrame, value: str, period: Column, group: str, combined: str = "combined") -> DataFrame:
    """Moments per (period, group) and per period over all groups, in one pass over expanded rows.

    Skewness and kurtosis are bias-corrected.
    """
    base = df.withColumn("period", period).filter(F.col("period").isNotNull()).withColumn(
        "__g", F.explode(F.array(F.col(group).cast("string"), F.lit(combined)))
    ).filter(F.col("__g").isNotNull())
    return moments_by(base.drop(group).withColumnRenamed("__g", group), ["period", group], value)


def moments_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, mean, median, std, variance, bias-corrected skewness and kurtosis."""
    x = F.col(value).cast("double")
    aggs = [
        F.count(x).alias("size"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("var"),
        sample_skewness(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"),
    ]
    return _with_medians(_not_null(df, keys), keys, [value], aggs, "__median").withColumnRenamed(f"{value}__median", "median")


def column_group_sums(groups: Mapping[str, Sequence[str]], have: Sequence[str]) -> list[Column]:
    """Sum of the existing member columns per group, nulls as 0."""
    out = []
    for name, members in groups.items():
        total = F.lit(0)
        for m in members:
            if m in have:
                total = total + F.coalesce(F.col(q(m)), F.lit(0))
        out.append(total.alias(name))
    return out


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str = "Meta one-hot encoding; ") -> DataFrame:
    return df.withColumns({f"{prefix}{col}: {v}": F.coalesce(F.col(q(col)) == v, F.lit(False)).cast("int") for v in values})


def frequency_encoding(df: DataFrame, col: str, prefix: str = "Meta frequency encoding; ") -> DataFrame:
    """Share of the row's category among all known categories."""
    shares = value_counts(df, [col], normalise=True, drop_nulls=True).select(col, F.col("share").alias(f"{prefix}{col}"))
    return df.join(shares, col, "left")


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of every pair over rows where both are known, with the number of such rows.

    Spearman ranks each column over its known values. Long form: keys, a, b, n, corr.
    """
    work = df
    names = {c: c for c in cols}
    if method == "spearman":
        for c in cols:
            names[c] = f"__rank_{c}"
            work = average_ranks(work, list(keys), c, names[c])
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            x, y = F.col(q(names[a])).cast("double"), F.col(q(names[b])).cast("double")
            both = x.isNotNull() & y.isNotNull()
            pairs.append((a, b))
            aggs.append(
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"),
                    F.count(F.when(both, 1)).alias("n"),
                    correlation(x, y).alias("corr"),
                ).alias(f"p{len(pairs)}")
            )
    wide = work.groupBy(*keys).agg(*aggs) if keys else work.agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[f"p{i + 1}" for i in range(len(pairs))])).alias("p")).select(*keys, "p.*")


def regression_metrics(actual: Column | str, predicted: Column | str) -> list[Column]:
    """Slope, intercept, correlation, RMSE, nRMSE and R² of predictions against actual values, as aggregates."""
    a = (F.col(actual) if isinstance(actual, str) else actual).cast("double")
    p = (F.col(predicted) if isinstance(predicted, str) else predicted).cast("double")
    both = a.isNotNull() & p.isNotNull()
    a, p = F.when(both, a), F.when(both, p)
    sse = F.sum(F.pow(a - p, 2))
    sst = F.var_pop(a) * F.count(a)
    rmse = F.sqrt(F.avg(F.pow(a - p, 2)))
    return [
        F.count(a).alias("size"),
        F.regr_slope(p, a).alias("slope"),
        F.regr_intercept(p, a).alias("intercept"),
        correlation(a, p).alias("pearson"),
        rmse.alias("rmse"),
        F.try_divide(rmse, F.stddev_samp(a)).alias("nrmse"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
    ]


def metrics_by_completeness(df: DataFrame, actual: str, predicted: str, available: str) -> DataFrame:
    """Metrics over rows at least 90, 80, … 10 percent complete, down to the first threshold met by all rows.

    That threshold is named ``Overall``. The deviation used for nRMSE is the population form.
    """
    steps = F.filter(F.array(*[F.lit(t) for t in range(90, 0, -10)]), lambda t: t <= F.col(available))
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rmse = F.sqrt(F.avg(F.pow(a - p, 2)))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = (
        df.withColumn("threshold", F.explode(steps))
        .groupBy("threshold")
        .agg(
            F.count(F.lit(1)).alias("size"),
            rmse.alias("rmse"),
            F.try_divide(rmse, F.stddev_pop(a)).alias("nrmse"),
            (1 - F.try_divide(F.sum(F.pow(a - p, 2)), F.var_pop(a) * F.count(a))).alias("r2"),
            correlation(a, p).alias("corr"),
        )
        .withColumn("__all", F.col("size") == rows)
    )
    first_all = per.filter("__all").agg(F.max("threshold").alias("t")).scalar()
    return per.filter(~F.col("__all") | (F.col("threshold") == first_all)).select(
        F.when(F.col("__all"), F.lit("Overall")).otherwise(F.col("threshold").cast("string")).alias("threshold"),
        "size", "rmse", "nrmse", "r2", "corr",
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Count and row share (two decimals) per pair of classes."""
    counts = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(actual).agg(F.sum("n").alias("__r"))
    return counts.join(rows, actual).select(actual, predicted, "n", F.bround(F.col("n") / F.col("__r"), 2).alias("share"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with micro F1 (accuracy) in every row."""
    counts = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    roles = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pre")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pre")),
            )
        ).alias("r"),
        F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    per = roles.groupBy("r.cls").agg(
        F.sum("r.sup").alias("support"), F.sum("r.pre").alias("chosen"), (F.sum("hit") / 2).alias("hits")
    )
    total = counts.agg((F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc")).scalar()
    precision = F.coalesce(F.try_divide("hits", "chosen"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return per.select(
        F.col("cls").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        "support",
        total.alias("f1_micro"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight rows / (classes · rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.select(label, "n", (total["n"] / (total["k"] * F.col("n"))).alias("weight"))


def histogram(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal bins, a tenth of the rows but 7 to 50 bins: bin, from, to, n (empty bins included)."""
    x = F.col(value).cast("double")
    src = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    if low is not None:
        src = src.filter(F.col("x") > low)
    if high is not None:
        src = src.filter(F.col("x") < high)
    head = src.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("rows"))
    head = head.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.least(F.greatest(F.floor(F.col("rows") / 10), F.lit(7)), F.lit(50)).alias("bins"),
    )
    h = head.select(F.struct("lo", "hi", "bins").alias("h")).scalar()
    width = (h["hi"] - h["lo"]) / h["bins"]
    counts = src.groupBy(
        F.least(F.floor((F.col("x") - h["lo"]) / width), h["bins"] - 1).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = head.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"), "lo", "hi", "bins")
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * step).alias("from"), (F.col("lo") + (F.col("bin") + 1) * step).alias("to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def overwrite_profile(df: DataFrame, base: str, other: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """How far filling ``base`` from ``other`` would meet known values, and the top differing pairs.

    First table: overwriting and differing shares in percent of the known values of
    ``other``, and the decision. Second table: the most frequent differing pairs.
    """
    b, o = F.col(q(base)), F.col(q(other))
    both, differs = b.isNotNull() & o.isNotNull(), b.isNotNull() & o.isNotNull() & (b != o)
    known_o = F.count(o)
    over = F.round(F.count(F.when(both, 1)) / F.nullif(known_o, F.lit(0)) * 100, 2)
    diff = F.round(F.count(F.when(differs, 1)) / F.nullif(known_o, F.lit(0)) * 100, 2)
    summary = df.agg(over.alias("overwriting_percent"), diff.alias("different_percent")).withColumn(
        "indicator", overlap_indicator(F.col("different_percent"))
    )
    pairs = (
        df.filter(differs).groupBy(b.alias("base"), o.alias("other")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "base", "other").limit(top)
    )
    return summary, pairs


def overlap_indicator(different_percent: Column) -> Column:
    d = different_percent
    return (
        F.when(d.isNull() | (d == 0), "True").when(d <= 10, "Maybe").when(d <= 25, "Probably not").otherwise("False")
    )


def integration_decision(row: Mapping[str, Column]) -> Column:
    """Text decision on uniting two columns from the shares, name and answer similarity and types.

    ``row``: different, overwriting, name_similarity, answer_similarity (nullable),
    type_similarity and number_similarity (text ``True`` when fine, nullable),
    integrated_overwriting and integrated_different (nullable).
    """
    d, over, name, ans = row["different"], row["overwriting"], row["name_similarity"], row["answer_similarity"]
    head = overlap_indicator(d)
    text = F.concat(
        head,
        F.when(name < 75, "? Probably not!?").when(name < 85, "? Maybe!?").when(name < 95, "? SC").otherwise(""),
    )
    note = F.concat(
        F.lit(" Cosine str similarity of answers (indicator, %): "), similarity_grade(ans), F.lit(", "),
        ans.cast("string"), F.lit("% "),
    )
    mark = F.when((ans < 92) & text.startswith("True"), "?").otherwise("")
    text = F.when(ans < 99, F.concat(text, mark, note)).otherwise(text)
    text = F.when(
        over > 0,
        F.concat(text, F.lit(" Caution! Overwriting: "), over.cast("string"), F.lit(" diff values: "), d.cast("string")),
    ).otherwise(text)
    text = F.when(
        name < 98, F.concat(text, F.lit(" Cosine str similarity of columns: "), name.cast("string"), F.lit("%"))
    ).otherwise(text)
    for key, label, tag in (
        ("type_similarity", "datatype similarity", "DT"),
        ("number_similarity", "numeric data similarity", "NS"),
    ):
        v = row[key]
        flagged = F.concat(text, F.lit(f" -- Caution! {label}: "), v)
        short = F.concat(F.lit(f"True? {tag} "), F.substring(flagged, F.lit(5), F.length(flagged)))
        text = F.when(v.isNull() | (v == "True"), text).when(flagged.startswith("True"), short).otherwise(flagged)
    io, idf = row["integrated_overwriting"], row["integrated_different"]
    return F.when(
        (F.coalesce(io, F.lit(0.0)) > 0) | (F.coalesce(idf, F.lit(0.0)) > 0),
        F.concat(
            text, F.lit(" -- Caution! overwriting in integrated! "), io.cast("string"), F.lit(" different values: "),
            idf.cast("string"), F.lit(" % of col2 data"),
        ),
    ).otherwise(text)


def similarity_grade(similarity: Column) -> Column:
    s = similarity
    return (
        F.when(s >= 98, "True").when(s >= 95, "Most Probably").when(s >= 90, "Probably").when(s >= 80, "Maybe")
        .when(s >= 70, "Probably not").when(s.isNotNull(), "False")
    )


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the known values of several columns in a row."""
    vals = F.filter(F.array(*[F.col(q(c)).cast("double") for c in cols]), lambda v: v.isNotNull())
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / F.size(vals))


def long_measures(df: DataFrame, area: str, year: str, measure: str, cols: Sequence[str]) -> DataFrame:
    """Area means per year and value type, standardised (population deviation) inside each type."""
    long = melt(df, [area, year], cols).withColumnRenamed("column", "value_type")
    means = long.groupBy(area, year, "value_type").agg(F.avg("value").alias("value"))
    scale = means.groupBy("value_type").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    return means.join(scale, "value_type").select(
        area, F.col(year).cast("int").alias(year), F.lit(measure).alias("measure"), "value_type",
        ((F.col("value") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).alias("value"),
    )


def mean_over_frames(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Cell-wise mean of several frames with the same rows; columns missing in a frame do not count."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy(key).agg(*[F.avg(q(c)).alias(c) for c in out.columns if c != key])


def split_statistics(df: DataFrame, split: str, value: str) -> DataFrame:
    """Moments per split, of the whole table and of the assigned rows."""
    x = F.col(value).cast("double")
    tags = F.array_compact(
        F.array(F.col(split).cast("string"), F.lit("whole ds"), F.when(F.col(split).isNotNull(), F.lit("assigned")))
    )
    return df.withColumn("slice", F.explode(tags)).groupBy("slice").agg(
        F.count(F.lit(1)).alias("size"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        sample_skewness(x).alias("skew"), sample_kurtosis(x).alias("kurtosis"),
    )


def split_spread(stats: DataFrame) -> DataFrame:
    """Population deviation over the splits of their means, deviations and sizes."""
    return stats.filter(~F.col("slice").isin("whole ds", "assigned")).agg(
        F.stddev_pop("mean").alias("std_of_means"), F.stddev_pop("std").alias("std_of_stds"),
        F.stddev_pop("size").alias("std_of_sizes"),
    )


def point_biserial(value: Column, flag: Column) -> Column:
    return correlation(value, flag)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per numeric column, in one long table."""
    from surveyspark.core.ordering import exact_quantiles

    long = melt(df, [], cols).filter(F.col("value").isNotNull())
    agg = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quart = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return agg.join(quart, "column")


def error_columns(df: DataFrame, actual: str = "Actual", predicted: str = "Prediction") -> DataFrame:
    err = F.col(predicted) - F.col(actual)
    return df.withColumns({"Error": err, "Absolute Error": F.abs(err)})


def merge_value_counts(counts: DataFrame, mapping: DataFrame, key: str = "answer", share: str = "percent") -> DataFrame:
    """Shares after merging answers (from, to); the total must stay the same within 0.1."""
    m = mapping.select(F.col("from").alias("__f"), F.col("to").alias("__t"))
    merged = (
        counts.join(m, F.col(key) == F.col("__f"), "left")
        .groupBy(F.coalesce("__t", key).alias(key))
        .agg(F.sum(share).alias(share))
    )
    before = counts.agg(F.sum(share).alias("s")).scalar()
    after = merged.agg(F.sum(share).alias("s")).scalar()
    same = F.when(F.abs(before - after) > 0.1, F.raise_error(F.lit("shares changed in merging")).cast("boolean")).otherwise(F.lit(True))
    return merged.filter(same)
