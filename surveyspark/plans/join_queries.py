"""Joins by key, interval, name, position and polygon."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions import text as tx
from surveyspark.operators import aggregates as ag
from surveyspark.operators import joins as jn
from surveyspark.operators import matching as mt
from surveyspark.operators import overlay as ov
from surveyspark.operators import quality as ql
from surveyspark.operators import sets as st
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views


@query(
    "households_with_locations",
    ["JN-1", "JN-2"],
    f"""{oracle_views('households', 'clusters')}, n AS (SELECT cluster, count(*) AS hh FROM households GROUP BY cluster)
        SELECT h.household, c.LATNUM, c.LONGNUM, n.hh FROM households h JOIN clusters c USING (cluster) LEFT JOIN n USING (cluster)""",
)
def households_with_locations(t: Tables):
    sizes = t.households.groupBy("cluster").agg(F.count(F.lit(1)).alias("hh"))
    loc = t.clusters.select("cluster", "LATNUM", "LONGNUM")
    return t.households.select("household", "cluster").join(loc, "cluster").join(sizes, "cluster", "left").drop("cluster")


@query(
    "outer_joined_surveys",
    ["JN-3"],
    """WITH a AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'),
         b AS (SELECT o_orderkey AS k, o_orderpriority FROM orders WHERE o_orderstatus <> 'O'),
         c AS (SELECT l_orderkey AS k, sum(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey)
       SELECT COALESCE(a.k, b.k, c.k) AS k, o_custkey, o_orderstatus, o_orderpriority, CAST(lines AS BIGINT) AS lines
       FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = COALESCE(a.k, b.k)""",
)
def outer_joined_surveys(t: Tables):
    o = t.orders.withColumnRenamed("o_orderkey", "k")
    a = o.filter("o_orderstatus <> 'F'").select("k", "o_custkey", "o_orderstatus")
    b = o.filter("o_orderstatus <> 'O'").select("k", "o_orderstatus", "o_orderpriority")
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_linenumber").alias("lines"))
    return jn.outer_join_new_columns([a, b, c], "k")


@query(
    "multi_key_join",
    ["JN-4", "AG-8"],
    f"""{oracle_views('households', 'clusters')}, i AS (SELECT adm0_name, adm1_name, adm2_name, DHSYEAR, avg(Actual) AS idx FROM clusters GROUP BY ALL)
        SELECT h.household, {r('i.idx', 8)} AS idx FROM households h LEFT JOIN i ON h.adm0_name = i.adm0_name AND h.adm1_name = i.adm1_name
          AND h.adm2_name = i.adm2_name AND h.year + 15 = i.DHSYEAR""",
)
def multi_key_join(t: Tables):
    keys = ["adm0_name", "adm1_name", "adm2_name"]
    index = t.clusters.groupBy(*keys, F.col("DHSYEAR").alias("year15")).agg(F.avg("Actual").alias("idx"))
    hh = t.households.select("household", *keys, (F.col("year") + 15).alias("year15"))
    return rounded(hh.join(index, [*keys, "year15"], "left").select("household", "idx"), 8)


_AREA = ["adm0_name", "adm1_name", "adm2_name"]


def span_sql() -> str:
    """Statistics of all spans from anchors ``a`` (date) and months ``p`` (date, IPC, FH)."""
    parts = []
    for s, e, u in jn.SPANS:
        unit = "MONTH" if u == "m" else "YEAR"
        for col, name in (("IPC", "IPC"), ("FH", "IPC + FH")):
            cond = f"p.date >= a.date + INTERVAL {s} {unit} AND p.date < a.date + INTERVAL {e} {unit}"
            label = f"FS; {name}: {s}-{e}{u}"
            parts.append(
                f"""{r(f"avg({col}) FILTER ({cond})")} AS "{label}: mean", max({col}) FILTER ({cond}) AS "{label}: max",
                min({col}) FILTER ({cond}) AS "{label}: min", round_even(median({col}) FILTER ({cond}), 0) AS "{label}: median" """
            )
    return ", ".join(parts)


@query(
    "interval_aggregate",
    ["JN-5", "PF-28"],
    f"""{oracle_views('phase_panel', 'households')}, p AS (SELECT *, CS AS IPC, CS + COALESCE(HA0, 0) AS FH, make_date(year, month, 1) AS date FROM phase_panel),
        a AS (SELECT survey, adm0_name, adm1_name, adm2_name, min(make_date(year, month, day)) AS date FROM households GROUP BY ALL)
        SELECT a.survey, a.adm2_name, {span_sql()} FROM a LEFT JOIN p ON a.adm2_name = p.adm2_name AND a.adm1_name = p.adm1_name AND a.adm0_name = p.adm0_name
        GROUP BY a.survey, a.adm2_name""",
)
def interval_aggregate(t: Tables):
    panel = ql.prepare_panel(t.phase_panel).withColumn("date", F.make_date("year", "month", F.lit(1)))
    anchors = t.households.groupBy("survey", *_AREA).agg(F.min(F.make_date("year", "month", "day")).alias("date"))
    out = jn.interval_aggregate(anchors, panel, _AREA, "date", "date", {"IPC": "IPC", "IPC + food help": "IPC + FH"})
    return rounded(out.drop("adm0_name", "adm1_name", "date"))


@query("semi_join", ["JN-6"], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(t: Tables):
    rich = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(rich, "c_custkey", "left_semi")


@query(
    "tile_labels_by_coordinates",
    ["JN-7", "SF-6", "SF-7"],
    f"{oracle_views('clusters')} SELECT cluster AS tile, cluster, {r('Actual', 8)} AS \"Actual\" FROM clusters WHERE cluster % 4 <> 0",
)
def tile_labels_by_coordinates(t: Tables):
    name = F.concat_ws("_", tx.truncate_decimal("LATNUM", 4), tx.truncate_decimal("LONGNUM", 4), F.lit("2015"))
    tiles = t.clusters.filter("cluster % 4 <> 0").select(F.col("cluster").alias("tile"), name.alias("Filename"))
    labels = t.clusters.select("cluster", "Actual", "LATNUM", "LONGNUM")
    return rounded(jn.tile_labels(tiles, labels).select("tile", "cluster", "Actual"), 8)


_MAIN_SOURCES = [
    "piped into dwelling", "piped to yard/plot", "public tap/standpipe", "protected well", "unprotected well", "protected spring",
    "unprotected spring", "spring", "public fountain", "water in plastic bag", "public borehole",
]


@query(
    "tile_labels_by_name",
    ["JN-8"],
    f"""{oracle_views('households')}, n AS (SELECT survey, cluster, source, count(*) AS n FROM households WHERE source IS NOT NULL GROUP BY ALL),
        m AS (SELECT survey, cluster, arg_min(source, (-n, source)) AS source FROM n GROUP BY ALL),
        k AS (SELECT *, substr(survey, 1, 2) || 'GE' || substr(survey, 5) || lpad(CAST(cluster AS VARCHAR), 8, '0') || '.tif' AS name FROM m WHERE source IN ('piped into dwelling', 'piped to yard/plot', 'public tap/standpipe', 'protected well', 'unprotected well', 'protected spring', 'unprotected spring', 'spring', 'public fountain', 'water in plastic bag', 'public borehole')),
        f AS (SELECT source, row_number() OVER (ORDER BY min(name), source) - 1 AS label FROM k GROUP BY source)
        SELECT name, source, label FROM k JOIN f USING (source)""",
)
def tile_labels_by_name(t: Tables):
    main = ag.majority(t.households, ["survey", "cluster"], "source").filter("source_max IS NOT NULL")
    survey_ge = F.concat(F.substring("survey", 1, 2), F.lit("GE"), F.expr("substring(survey, 5)"))
    tiles = main.select(F.concat(survey_ge, ql.zero_fill(F.col("cluster"), 8), F.lit(".tif")).alias("name"))
    pairs = main.select(F.col("survey").alias("HR"), survey_ge.alias("GE")).distinct()
    labels = main.select("survey", "cluster", F.col("source_max").alias("source"))
    return jn.tile_sources(tiles, labels, pairs, _MAIN_SOURCES)


@query(
    "survey_correspondence",
    ["JN-9"],
    f"""{oracle_views('households')}, h AS (SELECT DISTINCT survey, cc AS country, year, cluster FROM households),
        hs AS (SELECT survey, country, count(DISTINCT cluster) AS clusters FROM h GROUP BY ALL),
        ls AS (SELECT CASE WHEN substr(survey, 5, 1) IN ('2', '3') THEN country || 'GE' || substr(survey, 5) ELSE country || 'GX' || substr(survey, 5) END AS ge, country, clusters, survey AS hr FROM hs),
        y AS (SELECT ge, l.country, l.clusters, min(h.year) AS year FROM ls l JOIN h ON h.survey = l.hr GROUP BY ALL),
        nm AS (SELECT hs.survey, y.ge, y.year FROM hs JOIN y ON y.ge = substr(hs.survey, 1, 2) || 'GE' || substr(hs.survey, 5)),
        sh AS (SELECT hs.survey, min((y.ge, y.year)) AS m FROM hs JOIN (SELECT DISTINCT survey, year FROM h) hy USING (survey)
               JOIN y ON y.country = hs.country AND y.clusters = hs.clusters AND y.year = hy.year GROUP BY hs.survey)
        SELECT hs.survey AS HR, COALESCE(nm.ge, sh.m[1]) AS GE, hs.country, COALESCE(nm.year, sh.m[2]) AS year FROM hs LEFT JOIN nm USING (survey) LEFT JOIN sh USING (survey)""".replace("sh.m[1]", "struct_extract(sh.m, 1)").replace("sh.m[2]", "struct_extract(sh.m, 2)"),
)
def survey_correspondence(t: Tables):
    hh = t.households.select("survey", F.col("cc").alias("country"), "year", "cluster").distinct()
    tail = F.expr("substring(survey, 5)")
    kind = F.when(F.expr("substring(survey, 5, 1)").isin("2", "3"), "GE").otherwise("GX")
    loc = hh.withColumn("survey", F.concat("country", kind, tail))
    return jn.survey_correspondence(hh, loc)


def _rect(x0, y0, w, h):
    pts = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h)]
    return F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts]))


@query(
    "polygon_overlay",
    ["JN-10", "AG-17"],
    f"""WITH a AS (SELECT s_suppkey AS area, CAST(s_suppkey % 10 AS DOUBLE) * 4 AS x, CAST(s_suppkey // 10 AS DOUBLE) * 4 AS y FROM supplier),
        z AS (SELECT n_nationkey AS zone, CAST(n_nationkey % 5 AS DOUBLE) * 7 + 0.5 AS x, CAST(n_nationkey // 5 AS DOUBLE) * 7 + 0.25 AS y, 1 + n_nationkey % 7 AS phase FROM nation),
        o AS (SELECT area, zone, phase, greatest(0, least(a.x + 4, z.x + 7) - greatest(a.x, z.x)) * greatest(0, least(a.y + 4, z.y + 7) - greatest(a.y, z.y)) AS shared FROM a, z)
        SELECT area, zone_id, {r('shared', 9)} AS shared, {r('own', 9)} AS own, {r('ratio', 9)} AS area_ratio FROM (
          SELECT area, zone AS zone_id, shared, 16.0 AS own, shared / 16 AS ratio, row_number() OVER (PARTITION BY area ORDER BY shared DESC, zone) AS i
          FROM o WHERE shared / 16 >= 0.3 AND phase <= 5) WHERE i = 1""",
)
def polygon_overlay(t: Tables):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")

    def num(c):
        return F.floor(c).cast("double")

    four, seven = F.lit(4.0), F.lit(7.0)
    areas = t.supplier.select(s.alias("area"), _rect(num(s % 10) * 4, num(s / 10) * 4, four, four).alias("rings"))
    zones = t.nation.select(
        n.alias("zone_id"), _rect(num(n % 5) * 7 + 0.5, num(n / 5) * 7 + 0.25, seven, seven).alias("rings"), (1 + n % 7).alias("phase")
    )
    hits = ov.overlay_ratio(areas, zones, "area", "zone_id", min_ratio=0.3)
    hits = hits.join(zones.select("zone_id", "phase"), "zone_id")
    return rounded(jn.largest_overlap(hits, ["area"], "area_ratio", "phase").drop("phase"), 9)


_MONTHS = [f"{month:02d}{year}" for year in range(1992, 2002) for month in range(1, 13)]


@query(
    "panel_wide",
    ["JN-11"],
    f"""{oracle_views('phase_panel')} SELECT adm2_name, """
    + ", ".join(f"""max(CASE WHEN year = {m[2:]} AND month = {int(m[:2])} THEN CS END) AS "CS_{m}", max(CASE WHEN year = {m[2:]} AND month = {int(m[:2])} THEN HA0 END) AS "HA0_{m}" """ for m in _MONTHS)
    + " FROM phase_panel GROUP BY adm2_name",
)
def panel_wide(t: Tables):
    return jn.panel_wide(t.phase_panel, ["adm2_name"], ["CS", "HA0"], _MONTHS)


@query(
    "prefix_coordinate_match",
    ["JN-12"],
    f"""{oracle_views('clusters')}, c AS (SELECT cluster, adm1_name AS country, DHSYEAR AS year, CAST(LATNUM AS VARCHAR) AS la, CAST(LONGNUM AS VARCHAR) AS lo, lpad(CAST(cluster AS VARCHAR), 9, '0') AS id FROM clusters),
        w AS (SELECT t.cluster AS tile, min(c.id) AS lo3, max(c.id) AS hi3 FROM c t JOIN c ON t.country = c.country AND t.year = c.year AND (left(c.la, 3) = left(t.la, 3) OR left(c.lo, 3) = left(t.lo, 3)) GROUP BY ALL),
        n AS (SELECT t.cluster AS tile, min(c.id) AS lo4 FROM c t JOIN c ON t.country = c.country AND t.year = c.year AND (left(c.la, 4) = left(t.la, 4) OR left(c.lo, 4) = left(t.lo, 4)) GROUP BY ALL)
        SELECT tile, CASE WHEN lo3 = hi3 THEN lo3 ELSE lo4 END AS "DHSID" FROM w LEFT JOIN n USING (tile)""",
)
def prefix_coordinate_match(t: Tables):
    tiles = t.clusters.select(
        F.col("cluster").alias("tile"), F.col("adm1_name").alias("country"), F.col("DHSYEAR").alias("year"), F.col("LATNUM").alias("lat"), F.col("LONGNUM").alias("lon")
    )
    clusters = t.clusters.select(
        F.col("adm1_name").alias("country"), F.col("DHSYEAR").alias("year"), "LATNUM", "LONGNUM", F.lpad(F.col("cluster").cast("string"), 9, "0").alias("DHSID")
    )
    return jn.prefix_match(tiles, clusters).select("tile", "DHSID")


_HAV = "2 * 6371.0 * asin(least(sqrt(power(sin(radians(b.LATNUM - a.LATNUM) / 2), 2) + cos(radians(a.LATNUM)) * cos(radians(b.LATNUM)) * power(sin(radians(b.LONGNUM - a.LONGNUM) / 2), 2)), 1.0))"


@query(
    "nearest_next_year",
    ["JN-13", "SF-26"],
    f"""{oracle_views('clusters')}, y AS (SELECT adm0_name, DHSYEAR, lead(DHSYEAR) OVER (PARTITION BY adm0_name ORDER BY DHSYEAR) AS n FROM (SELECT DISTINCT adm0_name, DHSYEAR FROM clusters)),
        p AS (SELECT a.adm0_name, a.cluster, a.DHSYEAR, b.cluster AS next_id, b.DHSYEAR AS next_year, {_HAV} AS d FROM clusters a JOIN y USING (adm0_name, DHSYEAR)
              JOIN clusters b ON b.adm0_name = a.adm0_name AND b.DHSYEAR = y.n)
        SELECT adm0_name, cluster, DHSYEAR, next_year, {r('min(d)', 4)} AS distance FROM p GROUP BY ALL""",
)
def nearest_next_year(t: Tables):
    out = jn.nearest_next_year(t.clusters, "adm0_name", "cluster", start_km=100.0)
    return rounded(out.drop("next_id"), 4)


@query(
    "best_answer_match",
    ["JN-14", "AG-34"],
    f"""WITH l AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), ' ') AS w FROM part),
        b AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS answer FROM part),
        bs AS (SELECT answer, string_split(answer, ' ') AS w FROM b),
        s AS (SELECT p_partkey, answer, len(list_intersect(l.w, bs.w)) / sqrt(len(list_distinct(l.w)) * len(list_distinct(bs.w))) AS sim FROM l, bs),
        m AS (SELECT p_partkey, arg_min(answer, (-sim, answer)) AS match, max(sim) AS sim FROM s WHERE sim > 0.85 GROUP BY ALL)
        SELECT p_partkey, match, {r('sim * 100')} AS similarity FROM part LEFT JOIN m USING (p_partkey)""",
)
def best_answer_match(t: Tables):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")), " ")
    left = t.part.select(F.col("p_partkey").cast("string").alias("id"), words.alias("tokens"))
    answer = F.concat_ws(" ", "p_name", F.lower("p_type"))
    right = t.part.select(answer.alias("id")).distinct().withColumn("tokens", F.split("id", " "))
    out = mt.best_answer_match(left, right, "id", "tokens", 0.85)
    return out.select(F.col("id").cast("bigint").alias("p_partkey"), "match", "similarity")


@query(
    "scene_cloud_join",
    ["JN-15", "RS-8"],
    """WITH s AS (SELECT vec_id AS scene, label AS tile_id, unnest(embedding) AS value, unnest(range(64)) AS pos FROM embeddings),
        c AS (SELECT *, (scene * 31 + pos * 17) % 60 AS prob FROM s)
        SELECT tile_id, CAST(pos % 8 AS BIGINT) AS x, CAST(pos // 8 AS BIGINT) AS y, count(*) AS scenes, round(median(CAST(value AS DOUBLE)), 6) + 0.0::DOUBLE AS value
        FROM c WHERE prob < 20 AND pos BETWEEN 8 AND 55 GROUP BY ALL""",
)
def scene_cloud_join(t: Tables):
    from surveyspark.operators.raster import median_composite

    px = t.embeddings.select(F.col("vec_id").alias("scene"), F.col("label").alias("tile_id"), F.posexplode("embedding").alias("pos", "value"))
    px = px.select("scene", "tile_id", (F.col("pos") % 8).cast("bigint").alias("x"), F.floor(F.col("pos") / 8).alias("y"), F.col("value").cast("double").alias("value"))
    place = px.withColumns({"band": F.lit(0), "ts": F.lit("2015-07-01").cast("date"), "lat": F.col("y").cast("double"), "lon": F.col("x").cast("double")})
    clouds = px.select("scene", "x", "y", ((F.col("scene") * 31 + (F.col("y") * 8 + F.col("x")) * 17) % 60).alias("probability"))
    box = {"lat_min": F.lit(1.0), "lat_max": F.lit(6.0), "lon_min": F.lit(0.0), "lon_max": F.lit(7.0)}
    met = jn.scene_cloud_join(place, clouds, F.lit("2015-06-01").cast("date"), F.lit("2016-07-01").cast("date"), box)
    return rounded(median_composite(met).drop("band"))


@query(
    "year_over_year",
    ["JN-16"],
    f"""{oracle_views('clusters')} SELECT adm2_name, {r('avg(Actual) FILTER (DHSYEAR = 2015)', 8)} AS "Actual_x", {r('avg(Prediction) FILTER (DHSYEAR = 2015)', 8)} AS "Prediction_x",
        {r('avg(Actual) FILTER (DHSYEAR = 2018)', 8)} AS "Actual_y", {r('avg(Prediction) FILTER (DHSYEAR = 2018)', 8)} AS "Prediction_y"
        FROM clusters WHERE DHSYEAR IN (2015, 2018) GROUP BY adm2_name""",
)
def year_over_year(t: Tables):
    return rounded(jn.year_over_year(t.clusters, "adm2_name", "DHSYEAR", ["Actual", "Prediction"], 2015, 2018), 8)


@query(
    "best_admin_match",
    ["JN-17", "SF-13"],
    f"""{oracle_views('clusters')}, c AS (SELECT a.cluster, a.country, b.i, CASE WHEN (a.cluster + b.i) % 3 = 0 THEN 'NOWHERE' ELSE a.adm0_name END AS adm0_name, a.adm1_name,
          CASE WHEN (a.cluster + b.i) % 2 = 0 THEN 'zzzz' ELSE a.adm1_name END AS near FROM clusters a, (SELECT unnest(range(3)) AS i) b)
        SELECT cluster, i AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN country = adm0_name THEN 0 ELSE 1 END,
          CASE WHEN country = adm0_name AND near <> 'zzzz' THEN 0 ELSE 1 END, i) AS k FROM c) WHERE k = 1""",
)
def best_admin_match(t: Tables):
    c = t.clusters.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    turn = F.col("cluster") + F.col("i")
    rows = c.select(
        "cluster", "country", F.col("i").cast("bigint").alias("candidate"), F.when(turn % 3 == 0, "NOWHERE").otherwise(F.col("adm0_name")).alias("adm0_name"), "adm1_name",
        F.when(turn % 2 == 0, "zzzz").otherwise(F.col("adm1_name")).alias("ADM1NAME"), F.lit("zzzz").alias("DHSREGNA"),
    )
    return jn.best_admin_match(rows, "cluster", "candidate").select("cluster", "candidate")


@query(
    "location_deviation",
    ["JN-18"],
    f"""{oracle_views('clusters')} SELECT cluster, CASE WHEN cluster % 3 <> 0 THEN {r('sqrt(power(0.001 * (cluster % 5), 2) + power(0.002, 2))')} END AS "location deviation" FROM clusters""",
)
def location_deviation(t: Tables):
    index = t.clusters.filter("cluster % 3 <> 0").select(
        F.col("cluster").alias("ea"), (F.col("LATNUM") + 0.001 * (F.col("cluster") % 5)).alias("lat"), (F.col("LONGNUM") - 0.002).alias("lon")
    )
    return rounded(jn.with_location_deviation(t.clusters, index, "cluster", "ea").select("cluster", "location deviation"))


@query(
    "survey_start_year",
    ["JN-19"],
    f"{oracle_views('clusters', 'households')}, m AS (SELECT cc, min(DHSYEAR) AS y FROM clusters GROUP BY cc) SELECT household, y AS start_year FROM households JOIN m USING (cc)",
)
def survey_start_year(t: Tables):
    return jn.with_start_year(t.households.select("household", "cc"), t.clusters, "cc", "DHSYEAR").drop("cc")


# --- set operations and top-k -------------------------------------------------------------


@query(
    "outer_union",
    ["SO-1", "SO-2"],
    """SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS text, 'orders' AS origin FROM orders
       UNION ALL SELECT p_partkey, NULL, p_name, 'part' FROM part""",
)
def outer_union(t: Tables):
    frames = {
        "orders": t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        "part": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")),
    }
    return st.outer_union([st.tagged_union(frames, "origin")])


@query(
    "common_columns",
    ["SC-4", "SO-3"],
    f"""{oracle_views('households')}, m AS (SELECT DISTINCT survey, lower(fuel) AS label, fuel AS code FROM households WHERE fuel IS NOT NULL)
        SELECT label, count(DISTINCT survey) AS surveys, count(DISTINCT survey) = (SELECT count(DISTINCT survey) FROM m) AS common, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM m GROUP BY label""",
)
def common_columns(t: Tables):
    labels = t.households.filter("fuel IS NOT NULL").select("survey", F.col("fuel").alias("label"), F.col("fuel").alias("code")).distinct()
    return st.common_columns(labels).withColumn("codes", F.array_join("codes", ","))


@query(
    "uncommon_columns",
    ["SO-3"],
    f"""{oracle_views('households')} (SELECT DISTINCT source FROM households WHERE year = 1996 EXCEPT SELECT DISTINCT source FROM households WHERE year = 2001 AND adm0_name = 'ASIA' AND source LIKE '%p%')""",
)
def uncommon_columns(t: Tables):
    a = t.households.filter("year = 1996").select("source").distinct()
    b = t.households.filter("year = 2001 AND adm0_name = 'ASIA' AND source LIKE '%p%'").select("source").distinct()
    return a.exceptAll(b)


@query(
    "distinct_first",
    ["SO-4"],
    "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey",
)
def distinct_first(t: Tables):
    return st.distinct_first(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query(
    "powerset",
    ["SO-6"],
    """WITH o AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders), m AS (SELECT unnest(range(32)) AS k, l FROM o)
        SELECT array_to_string(list_filter(l, lambda x, i: (k >> (i - 1)) & 1 = 1), ',') AS subset, CAST(bit_count(k) AS INT) AS size FROM m""",
)
def powerset(t: Tables):
    return st.powerset(t.orders, "o_orderpriority").select(F.array_join("subset", ",").alias("subset"), "size")


@query(
    "top_value_pairs",
    ["TK-2"],
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_orderstatus, o_orderpriority LIMIT 10",
)
def top_value_pairs(t: Tables):
    return st.top_pairs(t.orders, ["o_orderstatus", "o_orderpriority"], 10)


@query(
    "random_sample",
    ["TK-4", "PF-27"],
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY substr(md5('5|' || o_orderkey), 1, 12) LIMIT 50",
)
def random_sample(t: Tables):
    return st.sample_rows(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 50, 5)


@query(
    "review_column_order",
    ["TK-5"],
    "SELECT c_name, c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer",
)
def review_column_order(t: Tables):
    return st.reorder_columns(t.customer, ["c_name"], {"c_custkey": ["c_mktsegment"]})


@query(
    "columns_by_availability",
    ["TK-1"],
    f"""{oracle_views('households')}, a AS (SELECT 'fuel' AS "column", count(fuel) AS n FROM households UNION ALL SELECT 'location', count(location) FROM households UNION ALL SELECT 'minutes', count(minutes) FROM households)
        SELECT "column", n, row_number() OVER (ORDER BY n DESC) AS rank FROM a""",
)
def columns_by_availability(t: Tables):
    from pyspark.sql import Window

    from surveyspark.core.ordering import melt

    counts = melt(t.households, [], ["fuel", "location", "minutes"], "string").groupBy("column").agg(F.count("value").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))))
