"""Indices, clusters, imputation, models and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import clustering as cl
from surveyspark.operators import density as de
from surveyspark.operators import evaluate as ev
from surveyspark.operators import impute as im
from surveyspark.operators import matching as mt
from surveyspark.operators import models as md
from surveyspark.operators import positions as po
from surveyspark.operators import splits as sp
from surveyspark.operators.aggregates import regression_metrics
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.aggregate_queries import metrics_sql
from surveyspark.plans.split_queries import hash_sql
from surveyspark.plans.views import oracle_views


@query(
    "pca_index",
    ["ML-1"],
    f"""WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS sb,
          CASE WHEN corr(l_quantity, l_extendedprice) < 0 THEN -1 ELSE 1 END AS d FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('((l_quantity - a) / sa + d * (l_extendedprice - b) / sb) / sqrt(2)', 5)} AS "index" FROM lineitem, m""",
)
def pca_index(t: Tables):
    """Of two standardised columns the first component is their scaled sum, or difference if they run against each other."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = md.pca_index(rows, ["l_quantity", "l_extendedprice"], "l_quantity")
    return rounded(out.drop("l_quantity", "l_extendedprice"), 5)


_STRATA = {"urban": "URBAN_RURA = 'U'", "rural": "URBAN_RURA = 'R'", "all": "TRUE"}
_TURN = "struct_pack(x := x + ab * y + ac * z, y := ab * x + y + bc * z, z := ac * x + bc * y + z)"


@query(
    "stratified_pca_index",
    ["ML-1"],
    f"""{oracle_views('clusters').replace("WITH", "WITH RECURSIVE", 1)},
        t AS ({" UNION ALL ".join(f"SELECT '{k}' AS s, cluster, Actual AS a, Prediction AS b, households AS c FROM clusters WHERE {cond}" for k, cond in _STRATA.items())}),
        g AS (SELECT s, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM t GROUP BY s),
        it(s, i, x, y, z) AS (SELECT s, 0, 0.7::DOUBLE, 0.7::DOUBLE, 0.1::DOUBLE FROM g UNION ALL
          SELECT s, i + 1, v.x / n, v.y / n, v.z / n FROM (SELECT s, i, v, sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS n FROM (SELECT it.s, i, {_TURN} AS v FROM it JOIN g ON g.s = it.s WHERE i < 200))),
        w AS (SELECT it.s, x, y, z, CASE WHEN x + ab * y + ac * z < 0 THEN -1 ELSE 1 END AS d FROM it JOIN g ON g.s = it.s WHERE i = 200),
        k AS (SELECT t.s, cluster, d * ((a - ma) / sa * x + (b - mb) / sb * y + (c - mc) / sc * z) AS score FROM t JOIN g ON g.s = t.s JOIN w ON w.s = t.s)
        SELECT cluster, {", ".join(f"{r(f"max(CASE WHEN s = '{k}' THEN score END)", 5)} AS \"PCA {k}\"" for k in _STRATA)} FROM k GROUP BY cluster""",
)
def stratified_pca_index(t: Tables):
    """Index for urban, rural and all clusters, oriented by the first column."""
    ur = F.col("URBAN_RURA")
    out = md.pca_index(
        t.clusters, ["Actual", "Prediction", "households"], "Actual", "PCA", [ur == "U", ur == "R", F.lit(True)], ["urban", "rural", "all"]
    )
    return rounded(out.select("cluster", "PCA urban", "PCA rural", "PCA all"), 5)


@query(
    "pca_reduction",
    ["ML-2"],
    f"""WITH RECURSIVE g AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_tax) AS mc, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, var_pop(l_tax) AS cc,
          covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_tax) AS ac, covar_pop(l_discount, l_tax) AS bc FROM lineitem),
        it(i, x, y, z) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
          SELECT i + 1, v.x / n, v.y / n, v.z / n FROM (SELECT i, v, sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS n FROM (
            SELECT i, struct_pack(x := aa * x + ab * y + ac * z, y := ab * x + bb * y + bc * z, z := ac * x + bc * y + cc * z) AS v FROM it, g WHERE i < 40)))
        SELECT l_orderkey, {r('(l_quantity - ma) * x + (l_discount - mb) * y + (l_tax - mc) * z', 5)} AS pc0 FROM lineitem, g, it WHERE i = 40""",
)
def pca_reduction(t: Tables):
    cols = ["l_quantity", "l_discount", "l_tax"]
    out, _ = md.pca_reduce(t.lineitem.select("l_orderkey", *cols), cols, 0.98)
    return rounded(out, 5)


_KM = 150.0
_HAV = "2 * 6371.0088 * asin(least(sqrt(power(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * power(sin(radians(b.lo - a.lo) / 2), 2)), 1.0))"


def _components_sql(view: str, edge: str) -> str:
    return f"""e AS ({edge}), reach(x, y) AS (SELECT id, id FROM {view} UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
        comp AS (SELECT x AS id, min(y) AS root, count(*) AS size FROM reach GROUP BY x)"""


@query(
    "spatial_clusters",
    ["ML-6"],
    oracle_views("clusters").replace("WITH", "WITH RECURSIVE", 1)
    + ", p AS (SELECT cluster AS id, LATNUM AS la, LONGNUM AS lo FROM clusters), "
    + _components_sql("p", f"SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND abs(a.la - b.la) < 3 AND {_HAV} <= {_KM}")
    + " SELECT id AS cluster, CASE WHEN size > 1 THEN root ELSE -1 END AS first_member FROM comp",
)
def spatial_clusters(t: Tables):
    out = po.cluster_positions(t.clusters, ["cluster"], _KM)
    heads = out.filter("clustered <> -1").groupBy("clustered").agg(F.min("cluster").alias("first_member"))
    return out.join(heads, "clustered", "left").select("cluster", F.coalesce("first_member", F.lit(-1)).alias("first_member"))


@query(
    "noise_groups",
    ["ML-6"],
    oracle_views("clusters").replace("WITH", "WITH RECURSIVE", 1)
    + ", p AS (SELECT cluster AS id, LATNUM AS la, LONGNUM AS lo FROM clusters), "
    + _components_sql("p", f"SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND abs(a.la - b.la) < 1 AND {_HAV} <= 40.0")
    + f""", z AS (SELECT id, row_number() OVER (ORDER BY {hash_sql(42, 'id')}) - 1 AS i FROM comp WHERE size = 1)
        SELECT comp.id AS cluster, size = 1 AS noise, CASE WHEN size = 1 THEN -1 - z.i // 30 ELSE root END AS grp FROM comp LEFT JOIN z USING (id)""",
)
def noise_groups(t: Tables):
    """Points without a neighbour, put into groups of thirty."""
    out = po.cluster_positions(t.clusters, ["cluster"], 40.0, noise="grouped")
    heads = out.filter("clustered <> -1").groupBy("clustered").agg(F.min("cluster").alias("head"))
    grp = F.coalesce("head", F.col("clustered: grouped non-clustered"))
    return out.join(heads, "clustered", "left").select("cluster", (F.col("clustered") == -1).alias("noise"), grp.alias("grp"))


@query(
    "vector_clusters",
    ["ML-7"],
    "WITH RECURSIVE p AS (SELECT vec_id AS id, embedding AS v FROM embeddings), "
    + _components_sql("p", "SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) <= 0.95")
    + " SELECT id AS vec_id, CASE WHEN size > 1 THEN root ELSE -1 END AS similar FROM comp",
)
def vector_clusters(t: Tables):
    return cl.cluster_vectors(t.embeddings, "vec_id", "embedding", 0.95).select("vec_id", "similar")


@query(
    "reachability_edges",
    ["ML-7"],
    f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
        n AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.id <> b.id
              QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 8),
        c AS (SELECT a, d AS core FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 2),
        t AS (SELECT id AS a, min(id) OVER (PARTITION BY v) AS b, 0.0 AS d FROM v QUALIFY a <> b),
        p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d FROM (SELECT * FROM n UNION ALL SELECT * FROM t) GROUP BY ALL)
        SELECT p.a, p.b, {r('greatest(d, x.core, y.core)')} AS w FROM p JOIN c x ON x.a = p.a JOIN c y ON y.a = p.b""",
)
def reachability_edges(t: Tables):
    """Mutual reachability of all embeddings and their eight nearest."""
    rows = t.embeddings.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(de.reachability_edges(rows, 8, 2))


@query("density_clusters", ["ML-7"])
def density_clusters(t: Tables):
    """Density clusters of all embeddings, standardised first."""
    vectors = cl.standardise_vectors(t.embeddings.filter("embedding IS NOT NULL"), "embedding", 64)
    return de.density_clusters(vectors, "vec_id", "embedding").select("vec_id", "similar")


@query("kmeans_labels", ["ML-8"])
def kmeans_labels(t: Tables):
    return cl.kmeans_labels(t.embeddings, "embedding", 64, 3).select("vec_id", "cluster")


def _answers(t: Tables):
    answer = F.concat_ws(" ", "p_name", F.lower("p_brand"))
    counts = t.part.groupBy(F.col("p_type").alias("column"), answer.alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("s"))
    return counts.join(totals, "column").select("column", "answer", (F.col("n") / F.col("s") * 100).alias("percent"))


def _answer_scores(t: Tables):
    """Similarity of answers that share words, for all questions at once."""
    answers = _answers(t)
    tokens = answers.select("answer").distinct().withColumn("tokens", F.split("answer", " "))
    pairs = mt.set_cosine_join(tokens, tokens, "answer", "tokens", 0.5, same=True)
    ids = mt.set_ids(tokens, "answer", "tokens")
    named = (
        pairs.join(ids.select(F.col("sid").alias("l"), F.col("answer").alias("a")), "l")
        .join(ids.select(F.col("sid").alias("r"), F.col("answer").alias("b")), "r")
    )
    left = answers.select("column", F.col("answer").alias("a"))
    right = answers.select("column", F.col("answer").alias("b"))
    return (
        named.join(left, "a").join(right, ["column", "b"])
        .select("column", "a", "b", (F.col("similarity") * 100).alias("score"), F.lit(True).alias("matched"))
    )


@query("unified_answers", ["ML-9", "AG-34"])
def unified_answers(t: Tables):
    mapping, _ = mt.unify_answers(_answers(t), _answer_scores(t))
    return mapping


@query("unified_answer_shares", ["ML-9"])
def unified_answer_shares(t: Tables):
    _, shares = mt.unify_answers(_answers(t), _answer_scores(t))
    return rounded(shares)


@query("integrated_columns", ["ML-10", "AG-26"])
def integrated_columns(t: Tables):
    """Candidate columns of a group compared with the most complete one, round after round."""
    from surveyspark.operators.integration import integrate_columns

    h, k = t.households, F.col("household")
    rows = h.select(
        "household", F.col("radio").alias("has radio"), F.when(k % 2 == 0, F.col("radio")).alias("has a radio"),
        F.when(k % 3 == 0, F.lit("yes")).otherwise(F.lit(None)).alias("owns radio"), F.when(k % 4 == 1, F.col("fuel")).alias("type of fuel"),
    )
    names = ["has radio", "has a radio", "owns radio", "type of fuel"]
    similar = {("has radio", "has a radio"): 96.0, ("has radio", "owns radio"): 90.0, ("has radio", "type of fuel"): 60.0,
               ("has a radio", "owns radio"): 88.0, ("has a radio", "type of fuel"): 60.0, ("owns radio", "type of fuel"): 61.0}
    return integrate_columns(rows, names, similar)


_MASK = f"{hash_sql('0-p_size', 'p_partkey')} / 281474976710656.0 < 0.2"


@query(
    "mean_imputation_scores",
    ["ML-11", "ML-12"],
    f"""WITH h AS (SELECT p_partkey, CASE WHEN {_MASK} THEN CAST(p_size AS DOUBLE) END AS was, CASE WHEN {_MASK} THEN NULL ELSE p_size END AS x FROM part)
        SELECT 'mean' AS imputer, 'overall' AS part, 'p_size' AS "column", count(was) AS n, {r('sqrt(avg(power(was - m, 2)) FILTER (was IS NOT NULL))')} AS rmse,
          {r('1 - sum(power(was - m, 2)) FILTER (was IS NOT NULL) / (var_pop(was) * count(was))')} AS r2 FROM h, (SELECT avg(x) AS m FROM h) GROUP BY ALL""",
)
def mean_imputation_scores(t: Tables):
    out = im.benchmark_imputers(t.part, "p_partkey", ["p_size"], {"mean": im.impute_mean}, share=0.2, seed=0)
    return rounded(out.drop("correlation"))


@query(
    "knn_imputation",
    ["ML-12"],
    f"""{oracle_views('clusters')}, h AS (SELECT cluster, LATNUM AS a, LONGNUM AS b, CASE WHEN cluster % 6 = 0 THEN NULL ELSE Actual END AS y FROM clusters),
        s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM h),
        z AS (SELECT cluster, (a - ma) / sa AS a, (b - mb) / sb AS b, y FROM h, s),
        d AS (SELECT x.cluster, o.y, row_number() OVER (PARTITION BY x.cluster ORDER BY power(x.a - o.a, 2) + power(x.b - o.b, 2), o.a, o.b) AS i FROM z x JOIN z o ON x.y IS NULL AND o.y IS NOT NULL)
        SELECT cluster, {r('y', 8)} AS "Actual" FROM h WHERE y IS NOT NULL UNION ALL SELECT cluster, {r('avg(y)', 8)} FROM d WHERE i <= 5 GROUP BY cluster""",
)
def knn_imputation(t: Tables):
    rows = t.clusters.select("cluster", "LATNUM", "LONGNUM", F.when(F.col("cluster") % 6 != 0, F.col("Actual")).alias("Actual"))
    return rounded(im.impute_knn(rows, "cluster", "Actual", ["LATNUM", "LONGNUM"], 5).select("cluster", "Actual"), 8)


def _gappy(t: Tables):
    k = F.col("cluster")
    return t.clusters.select(
        "cluster", F.when(k % 7 != 0, F.col("Actual")).alias("Actual"), F.when(k % 5 != 0, F.col("Prediction")).alias("Prediction"),
        F.col("households").cast("double").alias("households"),
    )


@query("chained_imputation", ["ML-13"])
def chained_imputation(t: Tables):
    return rounded(im.impute_chained(_gappy(t), "cluster", ["Actual", "Prediction", "households"], "bayesian", rounds=10), 4)


@query("chained_forest_imputation", ["ML-13"])
def chained_forest_imputation(t: Tables):
    return rounded(im.impute_chained(_gappy(t), "cluster", ["Actual", "Prediction", "households"], "forest", rounds=2), 4)


def _wide(t: Tables):
    h = t.households.groupBy("cluster").agg(
        F.avg("income").alias("DHS Num; income: mean"),
        *[F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)).alias(f"DHS Cat; status: {s}") for s in ("O", "F", "P")],
    )
    return h.withColumn("DHS Num; income: mean", F.when(F.col("cluster") % 9 != 0, F.col("DHS Num; income: mean")))


@query("imputation_benchmark", ["ML-11", "ML-14", "AG-29"])
def imputation_benchmark(t: Tables):
    """Mean and chained linear imputer scored on hidden values, one column of every question at a time."""
    cols = ["DHS Num; income: mean", "DHS Cat; status: O", "DHS Cat; status: F", "DHS Cat; status: P"]
    imputers = {
        "mean": im.impute_mean,
        "linear": lambda df, cs: im.impute_chained(df, "cluster", cs, "linear", rounds=2),
    }
    scores = im.benchmark_imputers(_wide(t), "cluster", cols, imputers, together=True, rotate=True)
    return rounded(im.summarise_scores(scores, im.availability(_wide(t), cols)))


def _roles(t: Tables):
    return sp.disjoint_fold_roles(t.clusters, "adm2_name", 3)


@query("cross_validated_linear", ["ML-15", "ML-4"])
def cross_validated_linear(t: Tables):
    pred = md.cross_validate(_roles(t), ["Prediction", "households"], "Actual", "cluster", ["role_0", "role_1", "role_2"], scale_label=True)
    return rounded(pred.groupBy("role").agg(*regression_metrics("Actual", "Prediction")), 5)


@query("cross_validated_boosting", ["ML-15"])
def cross_validated_boosting(t: Tables):
    pred = md.cross_validate(_roles(t), ["Prediction", "households"], "Actual", "cluster", ["role_0", "role_1", "role_2"], "boosting")
    return rounded(pred.groupBy("role").agg(*regression_metrics("Actual", "Prediction")), 5)


@query(
    "partial_dependence",
    ["ML-16"],
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {r('v', 8)} AS value, {r(f'2 + {w} * v + {o} * (SELECT avg({other}) FROM lineitem)', 8)} AS prediction
        FROM (SELECT DISTINCT unnest(quantile_cont({f}, [{', '.join(f'{i} / 9.0' for i in range(10))}])) AS v FROM lineitem)"""
        for f, w, other, o in (("l_quantity", 0.5, "l_discount", 3.0), ("l_discount", 3.0, "l_quantity", 0.5))
    ),
)
def partial_dependence(t: Tables):
    predict = md.linear_predictor(2.0, {"l_quantity": 0.5, "l_discount": 3.0})
    out = md.partial_dependence(t.lineitem.select("l_quantity", "l_discount"), predict, ["l_quantity", "l_discount"])
    return rounded(out, 8)


@query("price_anomalies", ["ML-17"])
def price_anomalies(t: Tables):
    out = md.isolation_forest(t.series, "idx", ["price"])
    return rounded(out.select("area", "idx", "anomaly_score", "anomaly"), 4)


# --- evaluation reports -------------------------------------------------------------------


def _levels_sql() -> str:
    parts = []
    for sig, cond in (("None", "TRUE"), ("3", "abs(Actual - m) <= 3 * s"), ("2", "abs(Actual - m) <= 2 * s")):
        for member, who in (("All", "TRUE"), ("Urban", "URBAN_RURA = 'U'"), ("Rural", "URBAN_RURA = 'R'")):
            for level, cols in ev.LEVELS.items():
                for by_year in (False, True):
                    names = ", ".join(f"{c if c in cols else 'NULL'} AS {c}" for c in ("adm0_name", "adm1_name", "adm2_name"))
                    year = "DHSYEAR" if by_year else "NULL"
                    parts.append(
                        f"""SELECT '{sig}' AS sigma, '{member}' AS member, '{level}' AS level, {str(by_year).lower()} AS by_year, {names}, {year} AS DHSYEAR,
                            count(*) AS clusters, CAST(sum(households) AS BIGINT) AS households_sum, avg(Actual) AS Actual, avg(Prediction) AS Prediction
                            FROM clusters, ms WHERE {cond} AND {who} GROUP BY {", ".join(cols + (["DHSYEAR"] if by_year else []))}"""
                    )
    return " UNION ALL ".join(parts)


_ROLL_SQL = f"{oracle_views('clusters')}, ms AS (SELECT avg(Actual) AS m, stddev_samp(Actual) AS s FROM clusters), roll AS ({_levels_sql()})"


@query(
    "area_rollup",
    ["AG-15"],
    f"""{_ROLL_SQL} SELECT sigma, member, level, by_year, adm0_name, adm1_name, adm2_name, CAST(DHSYEAR AS INT) AS "DHSYEAR", clusters, households_sum,
        {r('Actual', 8)} AS "Actual", {r('Prediction', 8)} AS "Prediction" FROM roll""",
)
def area_rollup(t: Tables):
    return rounded(ev.area_rollup(t.clusters), 8)


_SLICE_SQL = f"""{_ROLL_SQL}, named AS (
          SELECT member || ' ' || level || CASE WHEN by_year THEN ' Year' ELSE '' END AS b, ' STD ' || sigma AS e, * FROM roll),
        l AS (SELECT 'Test' AS slice, Actual, Prediction FROM clusters
          UNION ALL SELECT b || e, Actual, Prediction FROM named
          UNION ALL SELECT b || ' since 2015' || e, Actual, Prediction FROM named WHERE by_year AND DHSYEAR >= 2015
          UNION ALL SELECT b || ' before 2015' || e, Actual, Prediction FROM named WHERE by_year AND DHSYEAR < 2015
          UNION ALL SELECT b || ' AFRICA' || e, Actual, Prediction FROM named WHERE adm0_name = 'AFRICA'
          UNION ALL SELECT k || ' STD ' || sig, Actual, Prediction FROM (
            SELECT *, unnest(list_filter([CASE WHEN URBAN_RURA = 'U' THEN 'Urban' END, CASE WHEN URBAN_RURA = 'R' THEN 'Rural' END, CASE WHEN adm0_name = 'AFRICA' THEN 'AFRICA' END,
                CASE WHEN adm0_name = 'AFRICA' AND URBAN_RURA = 'U' THEN 'AFRICA urban' END, CASE WHEN adm0_name = 'AFRICA' AND URBAN_RURA = 'R' THEN 'AFRICA rural' END,
                CASE WHEN DHSYEAR < 2015 THEN 'Before 2015' END, CASE WHEN DHSYEAR >= 2015 THEN 'Since 2015' END,
                CASE WHEN DHSYEAR < 2015 AND URBAN_RURA = 'U' THEN 'Urban before 2015' END, CASE WHEN DHSYEAR >= 2015 AND URBAN_RURA = 'U' THEN 'Urban Since 2015' END,
                CASE WHEN DHSYEAR < 2015 AND URBAN_RURA = 'R' THEN 'Rural before 2015' END, CASE WHEN DHSYEAR >= 2015 AND URBAN_RURA = 'R' THEN 'Rural Since 2015' END], lambda x: x IS NOT NULL)) AS k
            FROM (SELECT c.*, s.sig FROM clusters c, ms, (SELECT unnest(['None', '3', '2']) AS sig) s
                  WHERE sig = 'None' OR (sig = '3' AND abs(Actual - m) <= 3 * ms.s) OR (sig = '2' AND abs(Actual - m) <= 2 * ms.s))))
        SELECT slice, {metrics_sql('Actual', 'Prediction')} FROM l GROUP BY slice HAVING count(Actual) >= 3"""


@query("slice_report", ["ML-19", "AG-15", "AG-21"], _SLICE_SQL)
def slice_report(t: Tables):
    return rounded(ev.slice_report(t.clusters, None, "AFRICA"))


_ROW_SLICES = ["Test"] + [
    f"{name} STD {sigma}" for sigma in ("None", "3", "2")
    for name in ("Urban", "Rural", "AFRICA", "AFRICA urban", "AFRICA rural", "Before 2015", "Since 2015", "Urban before 2015", "Urban Since 2015", "Rural before 2015", "Rural Since 2015")
]
_ROW_METRICS = ["slope", "intercept", "pearson", "rmse", "nrmse", "r2"]


@query(
    "report_row",
    ["ML-19"],
    f"""SELECT {", ".join(f"max(CASE WHEN slice = '{s}' THEN {m} END) AS \"{s} {m}\"" for s in _ROW_SLICES for m in _ROW_METRICS)} FROM ({_SLICE_SQL})""",
)
def report_row(t: Tables):
    """All row slices and metrics of the report side by side."""
    return rounded(ev.report_row(ev.slice_report(t.clusters, None, "AFRICA"), _ROW_SLICES, _ROW_METRICS))


_RADII = [*ev.RADII_KM, 50.0, _KM]


def _cluster_report_sql(by_year: bool) -> str:
    """Metrics per radius and region mode, of clusters or of their years."""
    metric = "count(*) AS {0}_size, " + r("sqrt(avg(power(Prediction - Actual, 2)))", 5) + " AS {0}_rmse, " + r("corr(Actual, Prediction)", 5) + " AS {0}_corr"
    year, between = ", DHSYEAR" if by_year else "", ""
    if by_year:
        between = f""", v AS (SELECT distance, mode, root, stddev_samp(Actual) AS a, stddev_samp(Prediction) AS p FROM m GROUP BY ALL),
            w AS (SELECT distance, mode, {r("avg(a)", 5)} AS actual_std_between_years, {r("avg(p)", 5)} AS prediction_std_between_years FROM v GROUP BY ALL)"""
    return f"""{oracle_views("clusters").replace("WITH", "WITH RECURSIVE", 1)}, p AS (SELECT cluster AS id, LATNUM AS la, LONGNUM AS lo FROM clusters),
        d AS (SELECT unnest({[float(km) for km in _RADII]}) AS distance),
        g AS (SELECT a.id AS a, b.id AS b, {_HAV} AS km FROM p a JOIN p b ON a.id <> b.id AND abs(a.la - b.la) < 3 AND {_HAV} <= {_KM}),
        reach(distance, x, y) AS (SELECT distance, id, id FROM p, d UNION SELECT reach.distance, reach.x, g.b FROM reach JOIN g ON reach.y = g.a AND g.km <= reach.distance),
        comp AS (SELECT distance, x AS id, min(y) AS root, count(*) AS size FROM reach GROUP BY distance, x),
        c AS (SELECT clusters.*, distance, root, size FROM clusters JOIN comp ON comp.id = cluster),
        t AS (SELECT c.*, mode, count(*) OVER (PARTITION BY distance, mode, root, size > 1{year}) AS n, bool_or(URBAN_RURA = 'U') OVER (PARTITION BY distance, mode, root, size > 1{year}) AS u
              FROM c, (SELECT unnest(['All', 'U', 'R', 'U+R']) AS mode) WHERE mode IN ('All', 'U+R') OR mode = URBAN_RURA),
        k AS (SELECT *, size > 1 AND (mode <> 'U+R' OR u) AND (mode = 'All' OR n >= 2) AS inside,
                size = 1 OR ((mode <> 'U+R' OR u) AND mode <> 'All' AND n = 1) AS outside FROM t),
        m AS (SELECT distance, mode, root{year}, avg(Actual) AS Actual, avg(Prediction) AS Prediction, stddev_samp(Actual) AS sa, stddev_samp(Prediction) AS sp FROM k WHERE inside GROUP BY distance, mode, root{year}),
        x AS (SELECT distance, mode, {metric.format("clustered")}, {r("avg(sa)", 5)} AS actual_std_in_cluster, {r("avg(sp)", 5)} AS prediction_std_in_cluster FROM m GROUP BY distance, mode),
        y AS (SELECT distance, mode, {metric.format("in_cluster")} FROM k WHERE inside GROUP BY distance, mode),
        z AS (SELECT distance, mode, {metric.format("out_of_cluster")} FROM k WHERE outside GROUP BY distance, mode){between}
        SELECT * FROM x FULL JOIN y USING (distance, mode) FULL JOIN z USING (distance, mode){" LEFT JOIN w USING (distance, mode)" if by_year else ""}"""


@query("cluster_evaluation", ["AG-16", "ML-6"], _cluster_report_sql(False))
def cluster_evaluation(t: Tables):
    return rounded(ev.cluster_evaluation(t.clusters, _RADII), 5)


@query("cluster_evaluation_by_year", ["AG-16", "ML-6"], _cluster_report_sql(True))
def cluster_evaluation_by_year(t: Tables):
    return rounded(ev.cluster_evaluation(t.clusters, _RADII, by_year=True), 5)


@query(
    "split_evaluation",
    ["ML-21", "SF-29"],
    f"""{oracle_views('clusters')}, p AS (SELECT CAST(cluster % 5 AS INT) AS split, Actual AS a, Prediction AS p, 0.5 * Actual + 3 AS ao, 0.5 * Prediction + 3 AS po FROM clusters)
        SELECT split, 'scaled' AS units, {metrics_sql('a', 'p')} FROM p GROUP BY split UNION ALL SELECT split, 'original', {metrics_sql('ao', 'po')} FROM p GROUP BY split""",
)
def split_evaluation(t: Tables):
    from surveyspark.operators.transforms import Scaling

    labels, predictions = t.clusters.select("cluster", F.col("Actual").alias("label")), t.clusters.select("cluster", "Prediction")
    out = None
    for split in range(5):
        _, metrics = ev.evaluate_split(labels.filter(F.col("cluster") % 5 == split), predictions, "cluster", Scaling(offset=3.0, scale=0.5))
        metrics = metrics.withColumn("split", F.lit(split))
        out = metrics if out is None else out.unionByName(metrics)
    return rounded(out)
