"""The long ways end to end on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions import text as tx
from surveyspark.operators import quality as ql
from surveyspark.plans import asset_wealth as aw
from surveyspark.plans import harmonise as hm
from surveyspark.plans import water_labels as wl
from surveyspark.plans.aggregate_queries import moments_sql
from surveyspark.plans.function_queries import _CLASS_SQL, _TIME_SQL, _WEIGHT_SQL
from surveyspark.plans.join_queries import span_sql
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views


def _located(t: Tables):
    tile = F.concat("cc", F.lit("GE5AFL"), ql.zero_fill(F.col("cluster"), 8))
    hh = t.households.select(
        tile.alias("GEID"), F.col("survey").alias("DHSID"), F.col("household").cast("string").alias("DHSID + HHID"),
        F.when(F.col("household") % 50 == 0, F.lit(-1)).otherwise(F.col("cluster")).cast("string").alias("cluster number"),
        F.col("year").cast("string").alias("year of interview"), F.col("month").cast("string").alias("month of interview"),
        F.when(F.col("household") % 60 != 1, F.col("day")).cast("string").alias("day of interview"),
        tx.null_tokens("minutes").alias("time to water"), F.col("fuel").alias("type of cooking fuel"), F.col("income").cast("string").alias("income"),
    )
    loc = t.clusters.select(
        F.concat("cc", F.lit("GE5AFL")).alias("GEID"), tile.alias("TIF_name"), "adm2_name", "adm1_name", "adm0_name",
        F.col("cluster").alias("DHSCLUST"), "URBAN_RURA",
    )
    return hm.located_households(hh, loc)


_HH_SQL = """h AS (SELECT *, make_date(year, month, least(day, 28)) AS d, CASE WHEN trim(minutes) IN ('nan', '') THEN NULL ELSE minutes END AS m FROM households
      WHERE household % 50 <> 0 AND household % 60 <> 1),
    g AS (SELECT adm2_name, adm1_name, adm0_name, count(*) AS n, median(date_diff('day', DATE '1970-01-01', d)) AS md, avg(income) AS im, median(income) AS ime,
      avg(TRY_CAST(m AS DOUBLE)) AS tm, count(TRY_CAST(m AS DOUBLE)) * 100.0 / count(*) AS tv,
      count(*) FILTER (m = 'on premises') / nullif(count(*) FILTER (m IS NOT NULL AND TRY_CAST(m AS DOUBLE) IS NULL), 0) AS op,
      1 - count(*) FILTER (m IS NOT NULL AND TRY_CAST(m AS DOUBLE) IS NULL) / count(*) AS mn,
      count(*) FILTER (URBAN_RURA = 'U') / count(*) AS u FROM h GROUP BY ALL)"""


@query(
    "survey_feature_table",
    ["JN-1", "PF-3", "PF-14", "AG-1", "AG-2", "AG-3", "AG-4", "AG-19", "WN-1", "SF-20"],
    f"""{oracle_views('households')}, {_HH_SQL}
        SELECT adm2_name AS "Meta; adm2_gaul", adm1_name AS "Meta; adm1_gaul", n AS "Meta; amount of households",
          year(TIMESTAMP '1970-01-01' + to_seconds(CAST(md * 86400 AS BIGINT))) AS "Meta; year", {r('im')} AS "DHS Num; income: mean", {r('ime')} AS "DHS Num; income: median",
          {r('tm')} AS "DHS Num; time to water: mean", {r('tv')} AS "Meta; DHS Num; time to water: percentage of valid answers",
          {r('op')} AS "DHS Cat; time to water: on premises", {r('mn')} AS "DHS Cat; time to water: NaN", {r('u')} AS "DHS Cat; URBAN_RURA: U",
          {r("CAST(adm0_name = 'ASIA' AS INT) * 1.0")} AS "Meta one-hot encoding; adm0_gaul: ASIA" FROM g""",
)
def survey_feature_table(t: Tables):
    out = hm.survey_features(_located(t))
    cols = [
        "Meta; adm2_gaul", "Meta; adm1_gaul", "Meta; amount of households", "Meta; year", "DHS Num; income: mean", "DHS Num; income: median",
        "DHS Num; time to water: mean", "Meta; DHS Num; time to water: percentage of valid answers", "DHS Cat; time to water: on premises",
        "DHS Cat; time to water: NaN", "DHS Cat; URBAN_RURA: U", "Meta one-hot encoding; adm0_gaul: ASIA",
    ]
    return rounded(out.select(*[F.col(f"`{c}`") for c in cols]))


@query(
    "enriched_feature_table",
    ["JN-4", "JN-5", "AG-9", "PF-28"],
    f"""{oracle_views('households', 'phase_panel', 'clusters')}, {_HH_SQL},
        f AS (SELECT *, CAST(DATE '1970-01-01' + CAST(floor(md) AS INT) AS DATE) AS date, year(DATE '1970-01-01' + CAST(floor(md) AS INT)) AS yr FROM g),
        p AS (SELECT *, CS AS IPC, CS + COALESCE(HA0, 0) AS FH, make_date(year, month, 1) AS date FROM phase_panel),
        s AS (SELECT a.adm2_name, {span_sql()} FROM f a LEFT JOIN p ON p.adm2_name = a.adm2_name AND p.adm1_name = a.adm1_name AND p.adm0_name = a.adm0_name GROUP BY a.adm2_name),
        e AS (SELECT adm2_name, DHSYEAR - 15 AS y, avg(Actual) AS edu FROM clusters WHERE cluster % 4 <> 0 GROUP BY ALL),
        i AS (SELECT adm2_name, DHSYEAR - 15 AS y, sum(Prediction * households) / sum(households) AS idx FROM clusters GROUP BY ALL)
        SELECT f.adm2_name AS "Meta; adm2_gaul", s.* EXCLUDE (adm2_name), {r('e.edu')} AS "DHS Education; edu", {r('i.idx')} AS "DHS Sustainbench; asset_index"
        FROM f JOIN s USING (adm2_name) LEFT JOIN e ON e.adm2_name = f.adm2_name AND e.y = f.yr LEFT JOIN i ON i.adm2_name = f.adm2_name AND i.y = f.yr""",
)
def enriched_feature_table(t: Tables):
    area = ["adm0_name", "adm1_name", "adm2_name"]
    year = (F.col("DHSYEAR") - 15).alias("year")
    out = hm.survey_features(_located(t))
    out = hm.add_phases(out, ql.prepare_panel(t.phase_panel))
    edu = t.clusters.select(*area, year, F.col("Actual").alias("edu"), (F.col("cluster") % 4 == 0).alias("Imputed"))
    out = hm.add_education(out, edu, ["edu"], "year")
    index = t.clusters.select(*area, year, F.col("Prediction").alias("asset_index"), F.col("households").alias("n_asset"))
    out = hm.add_area_indices(out, index)
    cols = ["Meta; adm2_gaul", *[c for c in out.columns if c.startswith("FS; ")], "DHS Education; edu", "DHS Sustainbench; asset_index"]
    return rounded(out.select(*[F.col(f"`{c}`") for c in cols]))


def _water(t: Tables):
    return t.households.select(
        F.col("cluster").cast("string").alias("DHSID"), "URBAN_RURA", F.col("source").alias(wl.SOURCE), F.col("minutes").alias(wl.TIME), F.col("location").alias(wl.PLACE)
    )


@query(
    "water_cluster_labels",
    ["SF-14", "SF-15", "SF-16", "SF-18", "SF-19", "AG-6", "AG-8", "PF-20", "JN-2"],
    f"""{_TIME_SQL.replace(oracle_views('households'), oracle_views('households', 'clusters'))}, x AS (SELECT *, {_WEIGHT_SQL} AS w, {_CLASS_SQL} AS cls FROM g),
        n AS (SELECT cluster, cls, count(*) AS n FROM x WHERE cls IS NOT NULL GROUP BY ALL),
        mj AS (SELECT cluster, arg_min(cls, (-n, cls)) AS top, max(n) * 100.0 / sum(n) AS p FROM n GROUP BY cluster),
        a AS (SELECT cluster, avg(w) AS w, stddev_samp(w) AS sd, avg(t) AS t, count(*) AS households FROM x GROUP BY cluster)
        SELECT CAST(a.cluster AS VARCHAR) AS "DHSID", {r('w')} AS weight, {r('sd')} AS weight_std, {r('t')} AS minutes, a.households, top AS class, {r('p')} AS class_percent,
          CASE WHEN t BETWEEN 0 AND 0 THEN '0 - 0 mins' WHEN t BETWEEN 1 AND 5 THEN '1 - 5 mins' WHEN t BETWEEN 6 AND 15 THEN '6 - 15 mins' WHEN t BETWEEN 16 AND 30 THEN '16 - 30 mins'
               WHEN t BETWEEN 31 AND 60 THEN '31 - 60 mins' WHEN t BETWEEN 61 AND 120 THEN '61 - 120 mins' WHEN t BETWEEN 121 AND 999 THEN '121 - 999 mins' END AS distance
        FROM a JOIN mj USING (cluster) JOIN clusters c USING (cluster) WHERE c.LATNUM NOT BETWEEN 0 AND 1e-8""",
)
def water_cluster_labels(t: Tables):
    loc = t.clusters.select(F.col("cluster").cast("string").alias("DHSID"), "LATNUM", "LONGNUM")
    out = wl.water_clusters(wl.water_households(_water(t)), loc)
    return rounded(
        out.select(
            "DHSID", F.col(f"`{wl.WEIGHT}`").alias("weight"), F.col(f"`Std Deviation: {wl.WEIGHT}`").alias("weight_std"),
            F.col(f"`{wl.FILLED_TIME}`").alias("minutes"), "households", F.col(f"`{wl.CLASS}: max`").alias("class"),
            F.col(f"`{wl.CLASS}: perc max`").alias("class_percent"), F.col(f"`{wl.BUCKET} cluster`").alias("distance"),
        )
    )


@query("water_indices", ["ML-1", "AG-31"])
def water_indices(t: Tables):
    out = wl.water_indices(wl.water_households(_water(t)), ["w_location_weighting", "cat_distance"])
    cols = [c for c in out.columns if c.startswith("PCA ")]
    return rounded(out.groupBy("DHSID").agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]), 5)


def _goods(t: Tables):
    k = F.col("household")
    flags = ["ELECTRICITY", "RADIO", "TV", "FRIDGE", "MOTORCYCLE", "CAR", "PHONE", "CELLPHONE"]
    return t.households.select(
        F.col("adm0_name").alias("survey"), F.lit("AA5").alias("HV000"), F.col("cluster").alias("CLUSTER"), k.alias("HOUSEHOLD"), F.col("year").alias("YEAR"),
        (1 + k % 7).alias("MEMBERS"), F.when(F.col("URBAN_RURA") == "U", 1).otherwise(2).alias("URBAN_RURAL"), (k % 5).alias("WATER_SOURCE"), (k % 4).alias("TOILET_TYPE"),
        (k % 3).alias("FLOOR"), (k % 6).alias("BEDROOMS"),
        *[(F.floor(k / (i + 2)) % 2).alias(f) if f != "PHONE" else F.when(F.col("adm0_name") != "ASIA", F.floor(k / 3) % 2).alias(f) for i, f in enumerate(flags)],
    )


def _quality(t: Tables):
    codes = t.nation.select(F.col("n_nationkey").alias("code"), (5 - F.col("n_nationkey") % 5).alias("quality"))
    return {c: codes for c in aw.RECODED}


@query("wealth_clusters", ["ML-1", "SF-15", "SF-34", "PF-23", "JN-2"])
def wealth_clusters(t: Tables):
    goods = aw.recoded_households(_goods(t), _quality(t))
    out = aw.cluster_wealth(aw.with_wealth_index(goods))
    loc = t.clusters.select(F.col("adm0_name").alias("survey"), F.col("cluster").alias("DHSCLUST"), "DHSYEAR", "URBAN_RURA", "LATNUM", "LONGNUM")
    return rounded(aw.wealth_locations(out, loc), 5)


@query(
    "recoded_goods",
    ["SF-15", "SF-34"],
    """SELECT o_orderkey AS "HOUSEHOLD", CAST(5 - o_orderkey % 5 AS DOUBLE) AS "WATER_SOURCE", CAST(5 - o_orderkey % 4 AS DOUBLE) AS "TOILET_TYPE", CAST(5 - o_orderkey % 3 AS DOUBLE) AS "FLOOR",
       round((o_orderkey % 6) / (1 + o_orderkey % 7), 6) AS "ROOMSPP" FROM orders""",
)
def recoded_goods(t: Tables):
    goods = aw.recoded_households(_goods(t), _quality(t))
    return rounded(goods.select("HOUSEHOLD", "WATER_SOURCE", "TOILET_TYPE", "FLOOR", "ROOMSPP"))


@query(
    "wealth_statistics",
    ["AG-13"],
    f"""{oracle_views('clusters')}, p AS (SELECT *, CASE WHEN DHSYEAR BETWEEN 2012 AND 2014 THEN '2012-2014' WHEN DHSYEAR = 2015 THEN '2015' WHEN DHSYEAR BETWEEN 2016 AND 2020 THEN '2016-2020' END AS period FROM clusters WHERE adm0_name <> 'ASIA')
        SELECT period, COALESCE(adm0_name, 'combined') AS "COUNTRY", {moments_sql('Actual')} FROM p WHERE period IS NOT NULL GROUP BY GROUPING SETS ((period, adm0_name), (period))""",
)
def wealth_statistics(t: Tables):
    rows = t.clusters.select(F.col("adm0_name").alias("COUNTRY"), F.col("DHSYEAR").alias("SURVEY_YEAR"), F.col("Actual").alias("WEALTH_INDEX"))
    out = aw.country_statistics(rows, ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"])
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("var", "skewness", "kurtosis")}))


@query(
    "external_clusters",
    ["SC-17"],
    f"""{oracle_views('clusters')} SELECT cluster AS "DHSCLUST", DHSYEAR AS "DHSYEAR", adm0_name AS "COUNTRY", CASE WHEN URBAN_RURA = 'U' THEN 0 ELSE 1 END AS "URBAN_RURA" FROM clusters WHERE DHSYEAR >= 2012""",
)
def external_clusters(t: Tables):
    raw = t.clusters.select(
        "cluster", F.concat("cc", F.col("DHSYEAR").cast("string")).alias("svyid"), F.col("Actual").alias("wealth"), F.col("cc").alias("cname"), F.col("cc").alias("hv000"),
        F.col("DHSYEAR").alias("year"), F.col("adm0_name").alias("country"), "households", "LATNUM", "LONGNUM", "URBAN_RURA",
    )
    return aw.external_clusters(raw).select("DHSCLUST", "DHSYEAR", "COUNTRY", "URBAN_RURA")


@query(
    "iso3_codes",
    ["SF-9", "PF-29"],
    f"""{oracle_views('clusters')} SELECT cluster, CASE WHEN adm1_name LIKE 'NATION_1%' THEN 'TZA' ELSE 'N' || substr(adm1_name, 8) END AS iso3, CASE WHEN cluster % 2 = 0 THEN 'KEN ' || DHSYEAR ELSE '2012–2014' END AS label FROM clusters""",
)
def iso3_codes(t: Tables):
    codes = t.nation.select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"), F.concat(F.lit("N"), F.expr("substring(n_name, 8)")).alias("code"))
    name = F.when(F.col("adm1_name").startswith("NATION_1"), "Tanzania").otherwise(F.col("adm1_name"))
    rows = t.clusters.select("cluster", "DHSYEAR", name.alias("country"))
    raw = F.when(F.col("cluster") % 2 == 0, F.concat_ws("_", F.lit("KE"), "DHSYEAR")).otherwise("kombiniert_2012_2014")
    return tx.with_iso3(rows, "country", codes).select("cluster", "iso3", tx.report_label(raw).alias("label"))


@query(
    "country_listing",
    ["SF-9"],
    """SELECT 'C' || n_nationkey AS code, n_name AS country FROM nation""",
)
def country_listing(t: Tables):
    """The JSON listing of countries, one document per region."""
    items = F.struct(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("DHS_CountryCode"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("CountryName"))
    docs = t.nation.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(items).alias("Data"))).alias("body"))
    return tx.country_names(docs, "body")
