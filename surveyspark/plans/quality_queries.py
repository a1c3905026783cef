"""Cleaning, selection, validity and uniqueness."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.core import namespaces as ns
from surveyspark.functions import text as tx
from surveyspark.operators import quality as ql
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views

_NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_NUM}) THEN CAST({x} AS DOUBLE) END"


@query(
    "number_or_text",
    ["PF-1"],
    f"{oracle_views('households')} SELECT household, {num('minutes')} AS number, CASE WHEN NOT regexp_matches(minutes, {_NUM}) THEN minutes END AS text FROM households",
)
def number_or_text(t: Tables):
    return t.households.select("household", tx.as_number("minutes").alias("number"), tx.as_text_remainder("minutes").alias("text"))


@query(
    "conversion_failures",
    ["PF-2", "PF-4"],
    f"""{oracle_views('households')}, l AS (SELECT household, 'minutes' AS "column", minutes AS value FROM households
        UNION ALL SELECT household, 'radio', radio FROM households)
        SELECT * FROM l WHERE value IS NOT NULL AND trim(value) NOT IN ('', 'nan') AND NOT regexp_matches(value, {_NUM})""",
)
def conversion_failures(t: Tables):
    return ql.conversion_failures(t.households, ["household"], ["minutes", "radio"])


@query(
    "split_mixed_columns",
    ["PF-3", "PF-14"],
    f"""{oracle_views('households')}, h AS (SELECT household, nullif(nullif(minutes, 'nan'), '') AS minutes, radio, fuel FROM households)
        SELECT household, {num('minutes')} AS "DHS Num; minutes", CASE WHEN NOT regexp_matches(minutes, {_NUM}) THEN minutes END AS "DHS Cat; minutes",
               {num('radio')} AS "DHS Num; radio", CASE WHEN NOT regexp_matches(radio, {_NUM}) THEN radio END AS "DHS Cat; radio",
               fuel AS "DHS Cat; fuel" FROM h""",
)
def split_mixed_columns(t: Tables):
    return ql.split_mixed(ql.clean_null_tokens(t.households, ["minutes"]), ["household"], ["minutes", "radio", "fuel"])


@query(
    "null_tokens",
    ["PF-4"],
    f"{oracle_views('households')} SELECT household, CASE WHEN trim(minutes) NOT IN ('nan', '') THEN minutes END AS minutes FROM households",
)
def null_tokens(t: Tables):
    return ql.clean_null_tokens(t.households.select("household", "minutes"), ["minutes"])


@query(
    "numbered_columns",
    ["PF-5"],
    """SELECT o_orderkey, o_orderkey AS "o_orderkey_Nr2", o_custkey, o_orderstatus FROM orders""",
)
def numbered_columns(t: Tables):
    o = t.orders.select("o_orderkey", "o_orderkey", "o_custkey", "o_orderkey", "o_orderstatus")
    return ql.number_duplicate_columns(o, max_copies=2)


@query(
    "drop_empty_columns",
    ["PF-6"],
    "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN p_size END AS big FROM part",
)
def drop_empty_columns(t: Tables):
    p = t.part.select(
        "p_partkey", "p_name", F.when(F.col("p_size") > 40, F.col("p_size")).alias("big"), F.when(F.col("p_size") < 0, 1).alias("never")
    )
    return ql.drop_empty_columns(p)


def _feature_table(t: Tables):
    """A small feature table in the name grammar."""
    h = t.households
    return h.groupBy("survey", "adm2_name").agg(
        F.max("adm0_name").alias("Meta; adm0_gaul"),
        F.max("year").alias("Meta; year"),
        F.max("month").alias("Meta; month"),
        F.max("survey").alias("Meta; GEID_init"),
        F.max("status").alias("Meta; note"),
        F.avg("income").alias("DHS Num; income: mean"),
        F.expr("percentile_approx(income, 0.5)").alias("DHS Num; income: median"),
        F.max("income").alias("DHS Num; income: std"),
        F.max(F.when(F.col("household") % 40 == 0, F.col("income"))).alias("DHS Num; rare: mean"),
        F.avg(F.when(F.col("radio") == "yes", 1.0).otherwise(0.0)).alias("DHS Cat; radio: yes"),
        F.avg(F.when(F.col("radio") == "no", 1.0).otherwise(0.0)).alias("DHS Cat; radio: no"),
        F.avg(F.when(F.col("radio").isNull(), 1.0).otherwise(0.0)).alias("DHS Cat; radio: NaN"),
        F.avg(F.when(F.col("status") == "O", 1.0).otherwise(0.0)).alias("DHS Cat; region: O"),
        F.avg(F.when(F.col("status") == "F", 1.0).otherwise(0.0)).alias("DHS Cat; only: F"),
        F.max("day").cast("double").alias("FS; IPC: 0-2y: mean"),
        F.max("day").cast("double").alias("FS; IPC: 0-2y: max"),
        F.max("day").cast("double").alias("FS; IPC: 1-2y: mean"),
        F.max("day").cast("double").alias("FS; IPC + FH: 0-2y: mean"),
    )


@query(
    "select_features",
    ["PF-7", "PF-8", "PF-9"],
    f"""{oracle_views('households')}
        SELECT max(adm0_name) AS "Meta; adm0_gaul", max(year) AS "Meta; year", max(month) AS "Meta; month", max(survey) AS "Meta; GEID_init",
               {r("avg(income)")} AS "DHS Num; income: mean", {r("max(income)")} AS "DHS Num; income: std",
               {r("avg(CASE WHEN radio = 'yes' THEN 1.0 ELSE 0.0 END)")} AS "DHS Cat; radio: yes",
               {r("max(day)")} AS "FS; IPC: 0-2y: mean"
        FROM households GROUP BY survey, adm2_name""",
)
def select_features(t: Tables):
    table = _feature_table(t).drop("survey", "adm2_name")
    out = ql.select_features(table, ql.FeatureOptions(drop_meta=True, numeric_type=None, min_percent=75))
    return rounded(out)


@query(
    "correlation_pairs",
    ["PF-10", "AG-20"],
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})')} AS corr FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax")]
    ),
)
def correlation_pairs(t: Tables):
    return rounded(ql.correlation_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]))


@query(
    "drop_correlated_columns",
    ["PF-10"],
    f"SELECT l_orderkey, {r('l_tax * 1.0')} AS tax, {r('l_extendedprice * 3')} AS price3 FROM lineitem",
)
def drop_correlated_columns(t: Tables):
    p = F.col("l_extendedprice")
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_linenumber") > 1, p).alias("price"), (p * 3).alias("price3"),
    )
    out = ql.drop_correlated(rows, 0.9)
    return rounded(out.withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")))


@query(
    "restrict_sample",
    ["PF-11", "JN-6"],
    f"""{oracle_views('clusters')} SELECT cluster, DHSYEAR, URBAN_RURA FROM clusters
        WHERE DHSYEAR >= 2012 AND URBAN_RURA = 'R' AND cc <> 'AA' AND cluster IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def restrict_sample(t: Tables):
    tiles = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("TIF_name"))
    rows = t.clusters.withColumn("TIF_name", F.col("cluster")).withColumn("GEID", F.col("cc"))
    return ql.restrict_sample(rows, 2012, "rural", tiles, ["AA"]).select("cluster", "DHSYEAR", "URBAN_RURA")


@query(
    "drop_outlier_surveys",
    ["PF-12"],
    f"""{oracle_views('clusters')}, m AS (SELECT avg(Actual) AS m, stddev_samp(Actual) AS s FROM clusters),
        g AS (SELECT adm2_name FROM clusters, m GROUP BY adm2_name, m, s HAVING abs(avg(Actual) - m) <= 0.2 * s)
        SELECT cluster, adm2_name FROM clusters WHERE adm2_name IN (SELECT adm2_name FROM g)""",
)
def drop_outlier_surveys(t: Tables):
    return ql.drop_outlier_groups(t.clusters, "adm2_name", "Actual", 0.2).select("cluster", "adm2_name")


@query(
    "sigma_trim_clip",
    ["PF-13"],
    f"""WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
        k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x FROM lineitem, m WHERE l_extendedprice BETWEEN m - 1.5 * s AND m + 2 * s),
        n AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM k)
        SELECT l_orderkey, l_linenumber, l_partkey, {r("greatest(x, m - 1 * s)", 4)} AS x FROM k, n""",
)
def sigma_trim_clip(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"))
    return rounded(ql.clip_sigma(ql.trim_sigma(rows, "x", 1.5, 2), "x", low=1), 4)


@query(
    "prefixed_columns",
    ["PF-14"],
    """SELECT c_custkey, c_name AS "Meta; c_name", c_nationkey AS "Meta; c_nationkey" FROM customer""",
)
def prefixed_columns(t: Tables):
    return ql.prefix_columns(t.customer.select("c_custkey", "c_name", "c_nationkey"), ns.META, ["c_custkey"])


@query(
    "composite_keys",
    ["PF-15"],
    f"""{oracle_views('households')} SELECT household, survey || lpad(CAST(cluster AS VARCHAR), 8, '0') AS dhsid,
        survey || lpad(CAST(cluster AS VARCHAR), 8, '0') || lpad(CAST(household AS VARCHAR), 8, '0') AS hhid,
        cc || CAST(year AS VARCHAR) || lpad(CAST(cluster AS VARCHAR), 8, '0') AS location_id,
        cc || '-' || CAST(year AS VARCHAR) || '-' || CAST(version AS VARCHAR) || '#-' || lpad(CAST(cluster AS VARCHAR), 8, '0') AS external FROM households""",
)
def composite_keys(t: Tables):
    return t.households.select(
        "household",
        ql.cluster_id("survey", "cluster").alias("dhsid"),
        ql.household_id("survey", "cluster", "household").alias("hhid"),
        ql.year_cluster_id(F.col("cc"), F.col("year"), F.col("cluster")).alias("location_id"),
        ql.external_id(F.col("cc"), F.col("year"), F.col("version").cast("string"), F.col("cluster")).alias("external"),
    )


@query(
    "duplicate_keys",
    ["PF-16"],
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(t: Tables):
    return ql.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("unique_orders", ["PF-16"], "SELECT o_orderkey, o_custkey FROM orders")
def unique_orders(t: Tables):
    return ql.require_unique(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "ids_in_several_surveys",
    ["PF-16", "SO-5"],
    f"{oracle_views('households')} SELECT cluster, count(DISTINCT survey) AS sources FROM households GROUP BY cluster HAVING count(DISTINCT survey) > 1",
)
def ids_in_several_surveys(t: Tables):
    return ql.ids_in_several(t.households, "cluster", "survey")


@query(
    "coordinate_rejects",
    ["PF-20", "SC-12"],
    f"""{oracle_views('clusters')}, c AS (SELECT cluster, CASE WHEN cluster % 10 = 0 THEN 0 ELSE LATNUM END AS lat, LONGNUM AS lon,
          LATNUM + CASE WHEN cluster % 7 = 0 THEN 0.02 ELSE 0 END AS lat2 FROM clusters)
        SELECT cluster, CASE WHEN lat = 0 OR lon = 0 THEN 'no position' WHEN abs(lat - lat2) >= 0.01 THEN 'positions differ' END AS reject FROM c""",
)
def coordinate_rejects(t: Tables):
    c = F.col("cluster")
    rows = t.clusters.select(
        "cluster", F.when(c % 10 == 0, 0.0).otherwise(F.col("LATNUM")).alias("lat"), F.col("LONGNUM").alias("lon"),
        (F.col("LATNUM") + F.when(c % 7 == 0, 0.02).otherwise(0.0)).alias("lat2"),
    )
    return ql.split_by_coordinates(rows, "lat", "lon", "lat2", "lon").select("cluster", "reject")


@query(
    "unified_columns",
    ["PF-21", "TK-1"],
    f"{oracle_views('households')} SELECT household, COALESCE(fuel, location, radio) AS answer FROM households",
)
def unified_columns(t: Tables):
    rows = t.households.select("household", "location", "fuel", F.when(F.col("household") % 8 == 0, F.col("radio")).alias("radio8"), "radio")
    order = ql.order_by_availability(rows, ["location", "fuel"])
    return ql.unify_columns(rows.drop("radio8"), {"answer": [*order, "radio"]})


@query(
    "repaired_areas",
    ["PF-22", "PF-26"],
    f"""{oracle_views('clusters')}, c AS (SELECT cluster, CASE WHEN cluster % 3 = 0 THEN NULL ELSE adm0_name END AS adm0_name, adm1_name,
          CASE country WHEN 'ASIA' THEN 'Asia' ELSE country END AS country FROM clusters)
        SELECT cluster, country, country AS adm0_name, adm1_name FROM c""",
)
def repaired_areas(t: Tables):
    c = F.col("cluster")
    rows = t.clusters.select(
        "cluster", "country", F.when(c % 3 != 0, F.col("adm0_name")).alias("adm0_name"), F.lit("EUROPE").alias("adm0_name_"),
        F.when(c % 4 != 0, F.col("adm1_name")).alias("adm1_name"), F.col("adm1_name").alias("adm1_name_"),
    )
    fixed = ql.repair_areas(rows, {"ASIA": "Asia"}, ("adm0_name", "adm1_name"))
    return fixed.select("cluster", "country", "adm0_name", "adm1_name")


@query(
    "complete_cases",
    ["PF-23"],
    f"{oracle_views('households')} SELECT household FROM households WHERE fuel IS NOT NULL AND location IS NOT NULL AND minutes IS NOT NULL",
)
def complete_cases(t: Tables):
    return ql.complete_cases(t.households, ["fuel", "location", "minutes"]).select("household")


@query(
    "missing_report",
    ["PF-23"],
    f"""{oracle_views('households')}
        SELECT 'fuel' AS "column", count(*) FILTER (fuel IS NULL) AS missing, count(*) AS rows FROM households
        UNION ALL SELECT 'location', count(*) FILTER (location IS NULL), count(*) FROM households
        UNION ALL SELECT 'any', count(*) FILTER (fuel IS NULL OR location IS NULL), count(*) FROM households""",
)
def missing_report(t: Tables):
    return ql.missing_report(t.households, ["fuel", "location"])


@query(
    "mixed_columns",
    ["PF-24"],
    f"""{oracle_views('households')}, l AS (SELECT 'minutes' AS "column", minutes AS v FROM households UNION ALL SELECT 'radio', radio FROM households
          UNION ALL SELECT 'fuel', fuel FROM households)
        SELECT "column", count(*) FILTER (regexp_matches(v, {_NUM})) AS numbers, count(*) FILTER (NOT regexp_matches(v, {_NUM})) AS texts FROM l
        GROUP BY "column" HAVING count(*) FILTER (regexp_matches(v, {_NUM})) > 0 AND count(*) FILTER (NOT regexp_matches(v, {_NUM})) > 0""",
)
def mixed_columns(t: Tables):
    return ql.mixed_columns(t.households, ["minutes", "radio", "fuel"])


@query(
    "labels_without_file",
    ["PF-25", "JN-6"],
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def labels_without_file(t: Tables):
    return ql.missing_inputs(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "country_mismatch",
    ["PF-26"],
    "SELECT s_suppkey, s.n_name AS supplier_nation, c.n_name AS customer_nation, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey "
    "JOIN nation c ON c_nationkey = c.n_nationkey WHERE s.n_name <> c.n_name GROUP BY ALL",
)
def country_mismatch(t: Tables):
    sup = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    cus = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("customer_nation"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(cus, F.col("o_custkey") == F.col("c_custkey"))
    return lines.filter("supplier_nation <> customer_nation").groupBy("s_suppkey", "supplier_nation", "customer_nation").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(
    "prepared_panel",
    ["PF-28"],
    f"""{oracle_views('phase_panel')} SELECT adm2_name, adm1_name, adm0_name, month, year, CS AS IPC, CS + COALESCE(HA0, 0) AS "IPC + food help" FROM phase_panel""",
)
def prepared_panel(t: Tables):
    return ql.prepare_panel(t.phase_panel)


@query(
    "relabelled_periods",
    ["PF-29"],
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN '1995-1997' WHEN year(o_orderdate) = 1998 THEN '1998' ELSE '1999-2001' END AS period FROM orders""",
)
def relabelled_periods(t: Tables):
    y = F.year("o_orderdate")
    raw = F.when(y < 1998, "1995_1997").when(y == 1998, "1998_1998").otherwise("1999_2001")
    return t.orders.select("o_orderkey", ql.relabel_periods(raw).alias("period"))
