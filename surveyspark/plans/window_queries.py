"""Group values on rows, rolling statistics, ranks and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.core.ordering import average_ranks, dense_index
from surveyspark.operators import windows as wn
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views


@query(
    "group_median_date",
    ["WN-1", "SF-20"],
    f"""{oracle_views('households')}, d AS (SELECT *, make_date(year, month, least(day, 28)) AS d FROM households),
        m AS (SELECT survey, adm2_name, median(date_diff('day', DATE '1970-01-01', d)) AS m FROM d GROUP BY ALL)
        SELECT household, strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(m * 86400 AS BIGINT)), '%Y-%m-%d %H') AS median_date
        FROM d JOIN m USING (survey, adm2_name)""",
)
def group_median_date(t: Tables):
    from surveyspark.functions.calendar import survey_date

    rows = t.households.withColumn("date", survey_date("year", "month", "day"))
    out = wn.with_group_median_date(rows, ["survey", "adm2_name"], "date")
    return out.select("household", F.date_format("median_date", "yyyy-MM-dd HH").alias("median_date"))


@query(
    "rounded_survey_year",
    ["WN-2"],
    f"""{oracle_views('households')}, m AS (SELECT adm2_name, CAST(round_even(avg(year), 0) AS INT) AS y FROM households GROUP BY ALL)
        SELECT household, y AS "rounded year" FROM households JOIN m USING (adm2_name)""",
)
def rounded_survey_year(t: Tables):
    return wn.with_rounded_group_year(t.households, "adm2_name", "year").select("household", "rounded year")


_ROLL = "PARTITION BY area ORDER BY idx ROWS BETWEEN"


@query(
    "rolling_pearson",
    ["WN-3"],
    f"""{oracle_views('series')}, w AS (SELECT area, idx, corr(price, affected) OVER ({_ROLL} 2 PRECEDING AND 1 FOLLOWING) AS c,
          count(*) OVER ({_ROLL} 2 PRECEDING AND 1 FOLLOWING) AS n,
          max(affected) OVER ({_ROLL} 2 PRECEDING AND 1 FOLLOWING) AS hi, min(affected) OVER ({_ROLL} 2 PRECEDING AND 1 FOLLOWING) AS lo FROM series)
        SELECT area, idx, CASE WHEN n = 4 AND hi > lo THEN {r('c', 5)} END AS rolling_r FROM w""",
)
def rolling_pearson(t: Tables):
    rows = dense_index(t.series, ["area"], "idx")
    return rounded(wn.rolling_pearson(rows, ["area"], "pos", "price", "affected", 4, block=16).select("area", "idx", "rolling_r"), 5)


@query(
    "rolling_spearman",
    ["WN-4"],
    f"""{oracle_views('series')}, p AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY idx) AS pos FROM series),
        w AS (SELECT a.area, a.idx, a.pos, b.pos AS bp, b.price, b.affected FROM p a JOIN p b ON a.area = b.area AND b.pos BETWEEN a.pos - 5 AND a.pos),
        k AS (SELECT area, idx, pos, rank() OVER (PARTITION BY area, idx ORDER BY price) + (count(*) OVER (PARTITION BY area, idx, price) - 1) / 2.0 AS x,
              rank() OVER (PARTITION BY area, idx ORDER BY affected) + (count(*) OVER (PARTITION BY area, idx, affected) - 1) / 2.0 AS y FROM w)
        SELECT area, idx, CASE WHEN count(*) = 6 AND max(x) > min(x) AND max(y) > min(y) THEN {r('corr(x, y)')} END AS rolling_rho FROM k GROUP BY area, idx""",
)
def rolling_spearman(t: Tables):
    rows = dense_index(t.series, ["area"], "idx")
    return rounded(wn.rolling_spearman(rows, ["area"], "pos", "price", "affected", 6, block=16).select("area", "idx", "rolling_rho"))


@query(
    "interpolated_series",
    ["WN-5"],
    f"""{oracle_views('series')}, g AS (SELECT area, idx, CASE WHEN (idx * 7) % 5 < 2 THEN NULL ELSE price END AS v FROM series),
        c AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY area ORDER BY idx) AS p,
              min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY area ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM g)
        SELECT c.area, c.idx, {r("CASE WHEN c.v IS NOT NULL THEN c.v WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v + (b.v - a.v) * (c.idx - c.p) / (c.n - c.p) ELSE a.v END", 4)} AS price
        FROM c LEFT JOIN g a ON a.area = c.area AND a.idx = c.p LEFT JOIN g b ON b.area = c.area AND b.idx = c.n""",
)
def interpolated_series(t: Tables):
    rows = t.series.select("area", "idx", F.when((F.col("idx") * 7) % 5 >= 2, F.col("price")).alias("price"))
    return rounded(wn.interpolate(rows, ["area"], "idx", "price", block=16), 4)


@query(
    "average_rank",
    ["WN-6"],
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
        + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem""",
)
def average_rank(t: Tables):
    return average_ranks(t.lineitem, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank")


@query(
    "weight_share",
    ["WN-7"],
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)', 9)} AS share FROM lineitem",
)
def weight_share(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(wn.weight_share(rows, ["l_orderkey"], "l_quantity").drop("l_quantity"), 9)


@query(
    "numbered_names",
    ["WN-8"],
    """WITH n AS (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS i FROM part)
        SELECT p_partkey, p_brand, CASE WHEN i > 1 THEN p_name || ' ' || i ELSE p_name END AS p_name FROM n""",
)
def numbered_names(t: Tables):
    return wn.number_duplicate_names(t.part.select("p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", "p_partkey")


@query(
    "top_scored_row",
    ["WN-9"],
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1""",
)
def top_scored_row(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return wn.top_one(rows, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query(
    "group_size_filter",
    ["WN-10"],
    """SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n,
        max(CAST(o_orderpriority = '1-URGENT' AS INT)) OVER (PARTITION BY o_custkey) AS f FROM orders) WHERE n >= 2 AND f = 1""",
)
def group_size_filter(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return wn.groups_with(rows, ["o_custkey"], 2, any_flag=F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")


@query(
    "single_row_groups",
    ["WN-10"],
    "SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1",
)
def single_row_groups(t: Tables):
    return wn.groups_with(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"], 1, 1)
