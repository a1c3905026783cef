"""Group statistics, shares, profiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import aggregates as ag
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views

FLAGS = ["A", "N", "R"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def pop_skew(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 THEN skewness({x}) * (count({x}) - 2) / sqrt(count({x}) * (count({x}) - 1.0)) END"


def _lines(t: Tables):
    cols = ["l_extendedprice", "l_discount", "l_quantity", "l_returnflag", "l_orderkey"]
    lines = t.lineitem.select(*cols).withColumn("l_discount", F.col("l_discount") + 0.0)
    orders = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    cust = t.customer.select("c_custkey", "c_nationkey")
    nation = t.nation.select("n_nationkey", "n_name")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )


LINES_SQL = """
    SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, l_extendedprice, l_discount + 0.0 AS l_discount, l_quantity, l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
"""


@query(
    "grouped_features",
    ["AG-1", "AG-3", "AG-4", "JN-1"],
    f"""
    WITH l AS ({LINES_SQL})
    SELECT n_name, year, count(*) AS households,
           {r("avg(l_extendedprice)")} AS price_mean, {r("median(l_extendedprice)")} AS price_median,
           {r("stddev_samp(l_extendedprice)")} AS price_std, {r(pop_skew("l_extendedprice"), 4)} AS price_skewness,
           {r("kurtosis_pop(l_extendedprice)", 4)} AS price_kurtosis,
           {r("count(l_extendedprice) * 100.0 / count(*)")} AS price_valid_percent,
           {r("avg(l_discount)")} AS discount_mean, {r("median(l_discount)")} AS discount_median,
           {r("stddev_samp(l_discount)")} AS discount_std, {r(pop_skew("l_discount"), 4)} AS discount_skewness,
           {r("kurtosis_pop(l_discount)", 4)} AS discount_kurtosis,
           {r("count(l_discount) * 100.0 / count(*)")} AS discount_valid_percent,
           {r("avg(CAST(l_returnflag = 'A' AS INT))")} AS flag_A,
           {r("avg(CAST(l_returnflag = 'N' AS INT))")} AS "flag_N",
           {r("avg(CAST(l_returnflag = 'R' AS INT))")} AS "flag_R",
           {r("avg(CAST(l_returnflag IS NULL AS INT))")} AS "flag_NaN"
    FROM l GROUP BY n_name, year
    """,
)
def grouped_features(t: Tables):
    keys = ["n_name", "year"]
    rows = _lines(t).select(
        *keys, F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag")
    )
    out = ag.grouped_feature_table(rows, keys, ["price", "discount"], {"flag": FLAGS}, namer=lambda c, k: f"{c}_{k}")
    four = [c for c in out.columns if c.endswith(("skewness", "kurtosis"))]
    return rounded(out.withColumns({c: F.round(c, 4) for c in four}))


@query(
    "first_known_value",
    ["AG-2"],
    f"""
    {oracle_views("households")}
    SELECT cluster, arg_min(fuel, household) FILTER (fuel IS NOT NULL) AS fuel,
           arg_min(location, household) FILTER (location IS NOT NULL) AS location
    FROM households GROUP BY cluster
    """,
)
def first_known_value(t: Tables):
    return t.households.groupBy("cluster").agg(
        ag.first_known("fuel", "household").alias("fuel"), ag.first_known("location", "household").alias("location")
    )


@query(
    "category_shares_long",
    ["AG-4"],
    f"""
    {oracle_views("households")}, c AS (
      SELECT adm2_name, 'fuel' AS "column", fuel AS category FROM households
      UNION ALL SELECT adm2_name, 'location', location FROM households),
    n AS (SELECT adm2_name, "column", category, count(*) AS n FROM c GROUP BY ALL),
    t AS (SELECT adm2_name, "column", sum(n) AS a, sum(CASE WHEN category IS NOT NULL THEN n ELSE 0 END) AS k FROM n GROUP BY ALL)
    SELECT adm2_name, "column", category, {r("n / k")} AS share FROM n JOIN t USING (adm2_name, "column") WHERE category IS NOT NULL
    UNION ALL SELECT adm2_name, "column", 'NaN', {r("(a - k) / a")} FROM t
    """,
)
def category_shares_long(t: Tables):
    return rounded(ag.category_shares(t.households, ["adm2_name"], ["fuel", "location"]))


_FUEL_SHARES = ", ".join(f"""{r(f"count(*) FILTER (fuel = '{p}') / nullif(count(fuel), 0)")} AS "DHS Cat; fuel: {p}" """ for p in PRIORITIES)


@query(
    "category_shares_wide",
    ["AG-4", "AG-1"],
    f"""
    {oracle_views("households")}
    SELECT adm2_name, {_FUEL_SHARES},
           {r("1 - count(fuel) / count(*)")} AS "DHS Cat; fuel: NaN", count(*) AS households,
           {r("avg(income)")} AS income_mean, {r("median(income)")} AS income_median
    FROM households GROUP BY adm2_name
    """,
)
def category_shares_wide(t: Tables):
    """Shares pivoted from the long form, beside the statistics of a number."""
    keys = ["adm2_name"]
    shares = ag.shares_wide(ag.category_shares(t.households, keys, ["fuel"]), keys, {"fuel": PRIORITIES})
    nums = ag.statistic_bundle(t.households, keys, ["income"]).select(*keys, "households", "income_mean", "income_median")
    return rounded(shares.join(nums, keys))


@query(
    "category_counts_wide",
    ["AG-5"],
    f"""
    {oracle_views("households")}
    SELECT cluster, """
    + ", ".join(f"""CAST(sum(CASE WHEN fuel = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS "fuel: {p}" """ for p in PRIORITIES)
    + " FROM households GROUP BY cluster",
)
def category_counts_wide(t: Tables):
    return ag.counts_wide(t.households, ["cluster"], "fuel", PRIORITIES)


@query(
    "majority_category",
    ["AG-6"],
    f"""
    {oracle_views("households")}, n AS (
      SELECT adm2_name, source, count(*) AS n FROM households WHERE source IS NOT NULL GROUP BY ALL)
    SELECT adm2_name, arg_min(source, (-n, source)) AS source_max, {r("max(n) * 100.0 / sum(n)")} AS source_perc_max
    FROM n GROUP BY adm2_name
    """,
)
def majority_category(t: Tables):
    return rounded(ag.majority(t.households, ["adm2_name"], "source"))


@query(
    "survey_crosstab",
    ["AG-7"],
    f"""
    {oracle_views("households")},
    y AS (SELECT cluster, year, count(*) AS n FROM households GROUP BY ALL),
    u AS (SELECT cluster, URBAN_RURA AS ur, count(*) AS n FROM households GROUP BY ALL),
    w AS (SELECT cluster, """
    + ", ".join(f"""CAST(sum(CASE WHEN fuel = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS "{p}" """ for p in PRIORITIES)
    + """ FROM households WHERE fuel IS NOT NULL GROUP BY cluster)
    SELECT w.*, yy.year, uu.residence FROM w
    LEFT JOIN (SELECT cluster, CAST(arg_min(year, (-n, CAST(year AS VARCHAR))) AS VARCHAR) AS year FROM y GROUP BY cluster) yy USING (cluster)
    LEFT JOIN (SELECT cluster, arg_min(ur, (-n, ur)) AS residence FROM u GROUP BY cluster) uu USING (cluster)
    """,
)
def survey_crosstab(t: Tables):
    return ag.survey_crosstab(t.households, ["cluster"], "fuel", PRIORITIES, "year", "URBAN_RURA")




@query(
    "dominant_source",
    ["AG-7"],
    """
    WITH c AS (SELECT l_orderkey, sum(l_linenumber) AS piped, sum(l_suppkey % 9) AS rain,
                      sum(l_partkey % 9) AS ground FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN piped >= greatest(rain, ground) THEN 'piped'
                            WHEN rain >= ground THEN 'rain' ELSE 'ground' END AS source FROM c
    """,
)
def dominant_source(t: Tables):
    counts = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("piped"), F.sum(F.col("l_suppkey") % 9).alias("rain"), F.sum(F.col("l_partkey") % 9).alias("ground")
    )
    return counts.select("l_orderkey", ag.majority_of_columns(["piped", "rain", "ground"]).alias("source"))


@query(
    "cluster_mean_std",
    ["AG-8"],
    f"""
    SELECT l_orderkey, {r("avg(l_quantity)")} AS l_quantity, {r("avg(l_extendedprice)")} AS l_extendedprice,
           {r("stddev_samp(l_quantity)")} AS "Std Deviation: l_quantity",
           {r("stddev_samp(l_extendedprice)")} AS "Std Deviation: l_extendedprice"
    FROM lineitem GROUP BY l_orderkey
    """,
)
def cluster_mean_std(t: Tables):
    return rounded(ag.mean_and_std(t.lineitem, ["l_orderkey"], ["l_quantity", "l_extendedprice"]))


@query(
    "weighted_statistics",
    ["AG-9"],
    f"""
    WITH m AS (SELECT l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, {r("max(m)", 4)} AS price, {r("sum(l_tax * l_extendedprice) / sum(l_extendedprice)")} AS tax,
           {r("sqrt(sum(l_quantity * (l_extendedprice - m) ** 2) / sum(l_quantity))", 3)} AS price_std
    FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag
    """,
)
def weighted_statistics(t: Tables):
    x, w = F.col("l_extendedprice"), F.col("l_quantity")
    out = t.lineitem.groupBy("l_returnflag").agg(
        F.round(ag.weighted_mean(x, w), 4).alias("price"), ag.weighted_mean(F.col("l_tax"), x).alias("tax"),
        F.round(ag.weighted_std(x, w), 3).alias("price_std"),
    )
    return rounded(out)


@query(
    "area_weighted_means",
    ["AG-9"],
    f"""
    {oracle_views("clusters")}
    SELECT adm1_name, DHSYEAR, {r("CASE WHEN count(v) = count(*) THEN sum(v * households) / sum(households) END")} AS index_value,
           {r("sum(Prediction * households) / sum(households)")} AS prediction
    FROM (SELECT *, CASE WHEN cluster % 17 = 0 THEN NULL ELSE Actual END AS v FROM clusters) GROUP BY ALL
    """,
)
def area_weighted_means(t: Tables):
    rows = t.clusters.withColumn("index_value", F.when(F.col("cluster") % 17 != 0, F.col("Actual"))).withColumn("prediction", F.col("Prediction"))
    w = F.col("households").cast("double")
    out = rows.groupBy("adm1_name", "DHSYEAR").agg(
        ag.weighted_mean(F.col("index_value"), w, poison=True).alias("index_value"),
        ag.weighted_mean(F.col("prediction"), w).alias("prediction"),
    )
    return rounded(out)


@query(
    "value_counts",
    ["AG-10"],
    f"""
    {oracle_views("households")}
    SELECT location, fuel, count(*) AS n, {r("count(*) / sum(count(*)) OVER ()")} AS share FROM households GROUP BY ALL
    """,
)
def value_counts(t: Tables):
    return rounded(ag.value_counts(t.households, ["location", "fuel"], normalise=True))


_PROFILE = ["minutes", "radio", "fuel", "location"]
_NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
_LONG_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", survey, version, nullif(nullif({c}, 'nan'), '') AS v FROM households""" for c in _PROFILE
)


@query(
    "column_profile",
    ["AG-11", "AG-12"],
    f"""
    {oracle_views("households")}, l AS ({_LONG_SQL}),
    x AS (SELECT *, CASE WHEN regexp_matches(v, {_NUM}) THEN CAST(v AS DOUBLE) END AS num FROM l),
    s AS (SELECT "column", survey, count(v) AS k, count(*) AS n FROM x GROUP BY ALL),
    ss AS (SELECT "column", {r("count(CASE WHEN k > 0 THEN 1 END) * 100.0 / count(*)")} AS surveys_with_data_percent,
                  {r("avg(CASE WHEN k > 0 THEN k * 100.0 / n END)")} AS mean_percent_in_surveys_with_data FROM s GROUP BY ALL)
    SELECT "column", count(v) AS available, {r("count(v) * 100.0 / count(*)")} AS available_percent,
           count(v) FILTER (version >= 5) AS available_recent,
           {r("count(v) FILTER (version >= 5) * 100.0 / count(*) FILTER (version >= 5)")} AS available_recent_percent,
           any_value(surveys_with_data_percent) AS surveys_with_data_percent,
           any_value(mean_percent_in_surveys_with_data) AS mean_percent_in_surveys_with_data,
           {r("count(num) * 100.0 / count(*)")} AS numeric_percent,
           {r("count(CASE WHEN v IS NOT NULL AND num IS NULL THEN 1 END) * 100.0 / count(*)")} AS string_percent,
           count(DISTINCT num) AS unique_numbers, {r("min(num)")} AS min, {r("max(num)")} AS max, {r("avg(num)")} AS mean,
           {r("stddev_samp(num)")} AS std,
           CASE WHEN count(num) > 0 AND count(CASE WHEN v IS NOT NULL AND num IS NULL THEN 1 END) > 0 THEN 'mixed'
                WHEN count(num) > 0 THEN 'numeric' ELSE 'categorical' END AS data_type
    FROM x JOIN ss USING ("column") GROUP BY "column"
    """,
)
def column_profile(t: Tables):
    from surveyspark.operators.quality import clean_null_tokens

    rows = clean_null_tokens(t.households, _PROFILE)
    return rounded(ag.profile_columns(rows, _PROFILE, "version", "survey", since_version=5))


@query(
    "availability_by_version",
    ["AG-12"],
    f"""
    {oracle_views("households")}, l AS ({_LONG_SQL})
    SELECT "column", version, count(v) AS available, {r("count(v) * 100.0 / count(*)")} AS available_percent FROM l GROUP BY ALL
    """,
)
def availability_by_version(t: Tables):
    from surveyspark.operators.quality import clean_null_tokens

    return rounded(ag.availability_by_version(clean_null_tokens(t.households, _PROFILE), _PROFILE, "version"))


def sample_skew(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 THEN skewness({x}) END"


def sample_kurt(x: str) -> str:
    return f"CASE WHEN count({x}) > 3 THEN kurtosis({x}) END"


def moments_sql(x: str) -> str:
    return f"""count({x}) AS size, {r(f"avg({x})")} AS mean, {r(f"stddev_samp({x})")} AS std, {r(f"var_samp({x})", 4)} AS var,
           {r(sample_skew(x), 4)} AS skewness, {r(sample_kurt(x), 4)} AS kurtosis, {r(f"median({x})")} AS median"""


def _moments_rounded(df):
    return rounded(df.withColumns({c: F.round(c, 4) for c in ("var", "skewness", "kurtosis")}))


_PERIOD_SQL = "CASE WHEN DHSYEAR < 2014 THEN '2012-2014' WHEN DHSYEAR = 2015 THEN '2015' WHEN DHSYEAR > 2015 THEN '2016-2020' END"


def _period():
    y = F.col("DHSYEAR")
    return F.when(y < 2014, "2012-2014").when(y == 2015, "2015").when(y > 2015, "2016-2020")


@query(
    "period_country_statistics",
    ["AG-13"],
    f"""
    {oracle_views("clusters")}, p AS (SELECT *, {_PERIOD_SQL} AS period FROM clusters)
    SELECT period, COALESCE(adm1_name, 'combined') AS adm1_name, {moments_sql("Actual")}
    FROM p WHERE period IS NOT NULL GROUP BY GROUPING SETS ((period, adm1_name), (period))
    """,
)
def period_country_statistics(t: Tables):
    return _moments_rounded(ag.period_statistics(t.clusters, "Actual", _period(), "adm1_name"))


@query(
    "period_region_type_statistics",
    ["AG-14"],
    f"""
    {oracle_views("clusters")}, p AS (SELECT *, {_PERIOD_SQL} AS period FROM clusters)
    SELECT period, {r("avg(Actual) FILTER (URBAN_RURA = 'U')")} AS mean_urban, {r("avg(Actual) FILTER (URBAN_RURA = 'R')")} AS mean_rural,
           {r("median(Actual) FILTER (URBAN_RURA = 'U')")} AS median_urban, {r("median(Actual) FILTER (URBAN_RURA = 'R')")} AS median_rural,
           {r("stddev_samp(Actual) FILTER (URBAN_RURA = 'U')")} AS std_urban, {r("stddev_samp(Actual) FILTER (URBAN_RURA = 'R')")} AS std_rural
    FROM p WHERE period IS NOT NULL GROUP BY period
    """,
)
def period_region_type_statistics(t: Tables):
    rows = t.clusters.withColumn("period", _period()).filter("period IS NOT NULL").withColumn(
        "ur", F.when(F.col("URBAN_RURA") == "U", "urban").otherwise("rural")
    )
    stats = ag.moments_by(rows, ["period", "ur"], "Actual")
    wide = stats.groupBy("period").pivot("ur", ["urban", "rural"]).agg(
        F.first("mean").alias("mean"), F.first("median").alias("median"), F.first("std").alias("std")
    )
    names = {f"{ur}_{s}": f"{s}_{ur}" for ur in ("urban", "rural") for s in ("mean", "median", "std")}
    return rounded(wide.withColumnsRenamed(names))


# Every answer of the view belongs to one group; answers nobody gives are allowed in the lists.
_COARSE = {
    "piped": ["piped into dwelling", "piped to yard/plot", "public tap/standpipe", "public fountain", "piped to neighbour's house", "neighbor's tap", "not there"],
    "groundwater": ["tube well or borehole", "protected well", "unprotected well", "protected spring", "unprotected spring", "public borehole", "open well in yard", "spring"],
    "rain": ["rainwater"],
    "surface": ["river/dam/lake/ponds/stream/canal/irrigation channel", "gravity flow scheme"],
    "delivered": ["tanker truck", "cart with small tank", "motorcycle with three wheels"],
    "packaged": ["bottled water", "sachet water", "water in plastic bag"],
    "other": ["other", "neighborhood"],
}


def _coarse_sql(answers: list[str]) -> str:
    names = ", ".join("'" + a.replace("'", "''") + "'" for a in answers)
    return f"CAST(count(*) FILTER (source IN ({names})) AS BIGINT)"


@query(
    "coarse_source_counts",
    ["AG-18"],
    f"{oracle_views('households')} SELECT cluster, {', '.join(f'{_coarse_sql(a)} AS {g}' for g, a in _COARSE.items())} FROM households GROUP BY cluster",
)
def coarse_source_counts(t: Tables):
    members = [m for g in _COARSE.values() for m in g if m != "not there"]
    wide = ag.counts_wide(t.households, ["cluster"], "source", members, prefix="")
    return wide.select("cluster", *ag.column_group_sums(_COARSE, wide.columns))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "encodings",
    ["AG-19"],
    f"""
    {oracle_views("clusters")}, f AS (SELECT adm1_name, count(*) / sum(count(*)) OVER () AS f FROM clusters GROUP BY adm1_name)
    SELECT cluster, {", ".join(f"""CAST(adm0_name = '{n}' AS INT) AS "Meta one-hot encoding; adm0_name: {n}" """ for n in _REGIONS)},
           {r("f", 9)} AS "Meta frequency encoding; adm1_name"
    FROM clusters JOIN f USING (adm1_name)
    """,
)
def encodings(t: Tables):
    rows = ag.one_hot(t.clusters.select("cluster", "adm0_name", "adm1_name"), "adm0_name", _REGIONS)
    return rounded(ag.frequency_encoding(rows, "adm1_name").drop("adm0_name", "adm1_name"), 9)


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUMS) for b in _NUMS[i + 1 :]]


@query(
    "pearson_matrix",
    ["AG-20"],
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in _PAIRS
    ),
)
def pearson_matrix(t: Tables):
    return rounded(ag.correlation_matrix(t.lineitem, _NUMS))


@query(
    "spearman_matrix",
    ["AG-20", "WN-6"],
    f"""
    {oracle_views("series")}, k AS (
      SELECT area, rank() OVER (PARTITION BY area ORDER BY price) + (count(*) OVER (PARTITION BY area, price) - 1) / 2.0 AS p,
             rank() OVER (PARTITION BY area ORDER BY affected) + (count(*) OVER (PARTITION BY area, affected) - 1) / 2.0 AS q FROM series)
    SELECT area, 'price' AS a, 'affected' AS b, count(*) AS n, {r("corr(p, q)")} AS corr FROM k GROUP BY area
    """,
)
def spearman_matrix(t: Tables):
    return rounded(ag.correlation_matrix(t.series, ["price", "affected"], "spearman", keys=["area"]))


def metrics_sql(a: str, p: str) -> str:
    return f"""count({a}) AS size, {r(f"regr_slope({p}, {a})")} AS slope, {r(f"regr_intercept({p}, {a})")} AS intercept,
       {r(f"corr({a}, {p})")} AS pearson, {r(f"sqrt(avg(({a} - {p}) ** 2))")} AS rmse,
       {r(f"sqrt(avg(({a} - {p}) ** 2)) / nullif(stddev_samp({a}), 0)")} AS nrmse,
       {r(f"1 - sum(({a} - {p}) ** 2) / nullif(var_pop({a}) * count({a}), 0)")} AS r2"""


@query(
    "regression_metrics",
    ["AG-21"],
    f"{oracle_views('clusters')} SELECT adm0_name, {metrics_sql('Actual', 'Prediction')} FROM clusters GROUP BY adm0_name",
)
def regression_metrics(t: Tables):
    return rounded(t.clusters.groupBy("adm0_name").agg(*ag.regression_metrics("Actual", "Prediction")))


@query(
    "metrics_by_completeness",
    ["AG-22"],
    f"""
    {oracle_views("clusters")}, c AS (SELECT *, 25 + (cluster * 13) % 76 AS available FROM clusters),
    t AS (SELECT unnest(range(90, 0, -10)) AS threshold),
    m AS (SELECT threshold, count(*) AS size, sqrt(avg((Actual - Prediction) ** 2)) AS rmse, stddev_pop(Actual) AS sd,
                 1 - sum((Actual - Prediction) ** 2) / (var_pop(Actual) * count(*)) AS r2, corr(Actual, Prediction) AS corr
          FROM c JOIN t ON available >= threshold GROUP BY threshold),
    a AS (SELECT *, size = (SELECT count(*) FROM c) AS everything FROM m)
    SELECT CASE WHEN everything THEN 'Overall' ELSE CAST(threshold AS VARCHAR) END AS threshold, size, {r("rmse")} AS rmse,
           {r("rmse / sd")} AS nrmse, {r("r2")} AS r2, {r("corr")} AS corr
    FROM a WHERE NOT everything OR threshold = (SELECT max(threshold) FROM a WHERE everything)
    """,
)
def metrics_by_completeness(t: Tables):
    rows = t.clusters.withColumn("available", 25 + (F.col("cluster") * 13) % 76)
    return rounded(ag.metrics_by_completeness(rows, "Actual", "Prediction", "available"))


_CLS = "l_returnflag AS a, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p"


def _classes(t: Tables):
    qty = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_returnflag").alias("actual"), F.when(qty < 20, "A").when(qty < 35, "N").otherwise("R").alias("predicted")
    )


@query(
    "confusion_matrix",
    ["AG-23"],
    f"""
    WITH c AS (SELECT a, p, count(*) AS n FROM (SELECT {_CLS} FROM lineitem) GROUP BY ALL)
    SELECT a AS actual, p AS predicted, n, round_even(n / sum(n) OVER (PARTITION BY a), 2) AS share FROM c
    """,
)
def confusion_matrix(t: Tables):
    return ag.confusion_matrix(_classes(t), "actual", "predicted")


@query(
    "class_report",
    ["AG-23"],
    f"""
    WITH c AS (SELECT {_CLS} FROM lineitem), k AS (SELECT DISTINCT a AS class FROM c),
    s AS (SELECT class, count(*) FILTER (a = class) AS sup, count(*) FILTER (p = class) AS pre, count(*) FILTER (a = class AND p = class) AS hit FROM k, c GROUP BY class)
    SELECT class, {r("hit / pre")} AS "precision", {r("hit / sup")} AS recall, {r("2.0 * hit / (sup + pre)")} AS f1, sup AS support,
           {r("(SELECT avg(CAST(a = p AS INT)) FROM c)")} AS f1_micro FROM s
    """,
)
def class_report(t: Tables):
    return rounded(ag.class_report(_classes(t), "actual", "predicted"))


@query(
    "class_weights",
    ["AG-24"],
    f"""
    SELECT label, count(*) AS n, {r("sum(count(*)) OVER () / (count(*) OVER () * count(*))", 9)} AS weight FROM embeddings GROUP BY label
    """,
)
def class_weights(t: Tables):
    return rounded(ag.class_weights(t.embeddings, "label"), 9)


@query(
    "histogram",
    ["AG-25"],
    f"""
    WITH h AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, least(greatest(count(*) // 10, 7), 50) AS b FROM customer),
    n AS (SELECT least(floor((c_acctbal - lo) / ((hi - lo) / b)), b - 1) AS bin, count(*) AS n FROM customer, h GROUP BY ALL)
    SELECT CAST(i AS BIGINT) AS bin, {r("lo + i * (hi - lo) / b")} AS "from", {r("lo + (i + 1) * (hi - lo) / b")} AS "to", coalesce(n, 0) AS n
    FROM h, unnest(range(0, (SELECT b FROM h))) AS u(i) LEFT JOIN n ON n.bin = i
    """,
)
def histogram(t: Tables):
    return rounded(ag.histogram(t.customer, "c_acctbal"))


@query(
    "overwrite_share",
    ["AG-26"],
    f"""
    {oracle_views("households")}, x AS (SELECT radio AS a, CASE WHEN household % 6 = 0 THEN NULL WHEN household % 10 = 1 THEN 'yes' ELSE radio END AS b,
      household FROM households), y AS (SELECT CASE WHEN household % 5 = 0 THEN NULL ELSE a END AS a, b FROM x),
    s AS (SELECT round(count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) * 100.0 / count(b), 2) AS o,
                 round(count(CASE WHEN a <> b THEN 1 END) * 100.0 / count(b), 2) AS d FROM y)
    SELECT o AS overwriting_percent, d AS different_percent,
           CASE WHEN d IS NULL OR d = 0 THEN 'True' WHEN d <= 10 THEN 'Maybe' WHEN d <= 25 THEN 'Probably not' ELSE 'False' END AS indicator FROM s
    """,
)
def overwrite_share(t: Tables):
    return ag.overwrite_profile(_two_candidates(t), "a", "b")[0]


def _two_candidates(t: Tables):
    h = F.col("household")
    return t.households.select(
        F.when(h % 5 != 0, F.col("radio")).alias("a"),
        F.when(h % 6 == 0, None).when(h % 10 == 1, "yes").otherwise(F.col("radio")).alias("b"),
    )


@query(
    "differing_pairs",
    ["AG-26", "TK-2"],
    f"""
    {oracle_views("households")}, x AS (SELECT CASE WHEN household % 5 = 0 THEN NULL ELSE radio END AS a,
      CASE WHEN household % 6 = 0 THEN NULL WHEN household % 10 = 1 THEN 'yes' ELSE radio END AS b FROM households)
    SELECT a AS base, b AS other, count(*) AS n FROM x WHERE a <> b GROUP BY ALL ORDER BY n DESC, base, other LIMIT 10
    """,
)
def differing_pairs(t: Tables):
    return ag.overwrite_profile(_two_candidates(t), "a", "b")[1]


@query(
    "ensemble_mean",
    ["AG-27"],
    f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           {r("list_avg(list_filter([CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END, l_discount * 100, l_tax * 100], lambda x: x IS NOT NULL))")} AS prediction
    FROM lineitem
    """,
)
def ensemble_mean(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("m0"),
        (F.col("l_discount") * 100).alias("m1"), (F.col("l_tax") * 100).alias("m2"),
    )
    return rounded(rows.withColumn("prediction", ag.row_mean(["m0", "m1", "m2"])).drop("m0", "m1", "m2"))


@query(
    "long_measures",
    ["AG-28"],
    f"""
    {oracle_views("clusters")}, l AS (
      SELECT adm2_name, DHSYEAR, 'Actual' AS value_type, Actual AS v FROM clusters
      UNION ALL SELECT adm2_name, DHSYEAR, 'Prediction', Prediction FROM clusters),
    m AS (SELECT adm2_name, DHSYEAR, value_type, avg(v) AS v FROM l GROUP BY ALL)
    SELECT adm2_name, DHSYEAR, 'water infrastructure' AS measure, value_type,
           {r("(v - avg(v) OVER (PARTITION BY value_type)) / stddev_pop(v) OVER (PARTITION BY value_type)")} AS value FROM m
    """,
)
def long_measures(t: Tables):
    return rounded(ag.long_measures(t.clusters, "adm2_name", "DHSYEAR", "water infrastructure", ["Actual", "Prediction"]))


@query(
    "mean_over_imputations",
    ["AG-29"],
    f"""
    SELECT p_partkey, {r("(p_size + p_size * 2.0 + 4) / 3")} AS p_size, {r("(p_retailprice + p_retailprice + 10) / 2")} AS p_retailprice FROM part
    """,
)
def mean_over_imputations(t: Tables):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    frames = [p, p.select("p_partkey", (F.col("p_size") * 2).alias("p_size"), (F.col("p_retailprice") + 10).alias("p_retailprice")),
              p.select("p_partkey", F.lit(4.0).alias("p_size"))]
    return rounded(ag.mean_over_frames(frames, "p_partkey"))


_SPLIT_SQL = "CASE WHEN cluster % 7 = 6 THEN NULL ELSE 'split ' || CAST(cluster % 7 % 3 AS VARCHAR) END"


def _with_split(t: Tables):
    c = F.col("cluster")
    return t.clusters.withColumn("split", F.when(c % 7 != 6, F.concat(F.lit("split "), (c % 7 % 3).cast("string"))))


_SPLIT_STATS = f"""
    {oracle_views("clusters")}, s AS (SELECT *, {_SPLIT_SQL} AS split FROM clusters),
    l AS (SELECT split AS slice, Actual AS x FROM s WHERE split IS NOT NULL
          UNION ALL SELECT 'whole ds', Actual FROM s UNION ALL SELECT 'assigned', Actual FROM s WHERE split IS NOT NULL),
    z AS (SELECT slice, count(*) AS size, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
           skewness(x) AS skew, kurtosis(x) AS kurtosis FROM l GROUP BY slice)
"""


@query(
    "split_statistics",
    ["AG-30"],
    f"""{_SPLIT_STATS} SELECT slice, size, {r("mean")} AS mean, {r("std")} AS std, {r("min")} AS min, {r("max")} AS max,
        {r("skew", 4)} AS skew, {r("kurtosis", 4)} AS kurtosis FROM z""",
)
def split_statistics(t: Tables):
    out = ag.split_statistics(_with_split(t), "split", "Actual")
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("skew", "kurtosis")}))


@query(
    "split_spread",
    ["AG-30"],
    f"""{_SPLIT_STATS} SELECT {r("stddev_pop(mean)")} AS std_of_means, {r("stddev_pop(std)")} AS std_of_stds,
        {r("stddev_pop(size)")} AS std_of_sizes FROM z WHERE slice LIKE 'split%'""",
)
def split_spread(t: Tables):
    return rounded(ag.split_spread(ag.split_statistics(_with_split(t), "split", "Actual")))


@query(
    "point_biserial",
    ["AG-31"],
    f"SELECT o_orderstatus, {r('corr(o_totalprice, CAST(o_orderpriority = ' + chr(39) + '1-URGENT' + chr(39) + ' AS INT))')} AS r FROM orders GROUP BY o_orderstatus",
)
def point_biserial(t: Tables):
    return rounded(
        t.orders.groupBy("o_orderstatus").agg(
            ag.point_biserial(F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT").alias("r")
        )
    )


@query(
    "describe",
    ["AG-32"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f"avg({c})")} AS mean, {r(f"stddev_samp({c})")} AS std, {r(f"min({c})")} AS min,
            {r(f"max({c})")} AS max, {r(f"quantile_cont({c}, 0.25)")} AS p25, {r(f"quantile_cont({c}, 0.5)")} AS p50, {r(f"quantile_cont({c}, 0.75)")} AS p75 FROM lineitem"""
        for c in _NUMS
    ),
)
def describe(t: Tables):
    return rounded(ag.describe(t.lineitem, _NUMS))


@query(
    "error_summary",
    ["AG-33"],
    f"""
    {oracle_views("clusters")} SELECT adm1_name, {r("avg(Prediction - Actual)")} AS error, {r("avg(abs(Prediction - Actual))")} AS absolute_error,
      {r("stddev_samp(abs(Prediction - Actual))")} AS absolute_error_std FROM clusters GROUP BY adm1_name
    """,
)
def error_summary(t: Tables):
    rows = ag.error_columns(t.clusters)
    return rounded(
        rows.groupBy("adm1_name").agg(
            F.avg("Error").alias("error"), F.avg("`Absolute Error`").alias("absolute_error"),
            F.stddev_samp("`Absolute Error`").alias("absolute_error_std"),
        )
    )


@query(
    "merged_value_counts",
    ["AG-34"],
    f"""
    {oracle_views("households")}, n AS (SELECT source AS answer, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM households WHERE source IS NOT NULL GROUP BY source)
    SELECT CASE answer WHEN 'sachet water' THEN 'bottled water' WHEN 'spring' THEN 'unprotected spring' ELSE answer END AS answer,
           {r("sum(percent)")} AS percent FROM n GROUP BY 1
    """,
)
def merged_value_counts(t: Tables):
    shares = ag.value_counts(t.households, ["source"], True, True).select(F.col("source").alias("answer"), (F.col("share") * 100).alias("percent"))
    mapping = t.spark.createDataFrame([("sachet water", "bottled water"), ("spring", "unprotected spring")], "from string, to string")
    return rounded(ag.merge_value_counts(shares, mapping))
