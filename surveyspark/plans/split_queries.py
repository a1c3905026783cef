"""Folds, splits and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import splits as sp
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import oracle_views


def hash_sql(seed, *cols: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "), 1, 12)) AS BIGINT)"


def even_part_sql(pos: str, n: str, k: str) -> str:
    small, extra = f"({n} // {k})", f"({n} % {k})"
    return f"CASE WHEN {pos} < {extra} * ({small} + 1) THEN {pos} // ({small} + 1) ELSE {extra} + ({pos} - {extra} * ({small} + 1)) // {small} END"


_RANKED = f"k AS (SELECT adm2_name, row_number() OVER (ORDER BY {hash_sql(42, 'adm2_name')}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT adm2_name FROM clusters))"


@query(
    "group_folds",
    ["ML-3"],
    f"{oracle_views('clusters')}, {_RANKED} SELECT cluster, CAST({even_part_sql('pos', 'n', '5')} AS INT) AS fold FROM clusters JOIN k USING (adm2_name)",
)
def group_folds(t: Tables):
    return sp.assign_folds(t.clusters, "adm2_name", 5).select("cluster", "fold")


@query(
    "row_folds",
    ["ML-3"],
    f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}) - 1 AS pos, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, CAST({even_part_sql('pos', 'n', '5')} AS INT) AS fold FROM k""",
)
def row_folds(t: Tables):
    return sp.assign_folds(t.orders.select("o_orderkey"), "o_orderkey", 5)


@query(
    "fold_roles",
    ["ML-4"],
    f"{oracle_views('clusters')}, {_RANKED}, f AS (SELECT cluster, CAST({even_part_sql('pos', 'n', '3')} AS INT) AS fold FROM clusters JOIN k USING (adm2_name)) SELECT cluster, "
    + ", ".join(
        f"CASE WHEN fold = {i} THEN 'test' WHEN {hash_sql(f'42-{i}', 'cluster')} / 281474976710656.0 < 0.2 THEN 'val' ELSE 'train' END AS role_{i}" for i in range(3)
    )
    + " FROM f",
)
def fold_roles(t: Tables):
    return sp.fold_roles(t.clusters, "adm2_name", ["cluster"], 3).select("cluster", "role_0", "role_1", "role_2")


def _disjoint_sql() -> str:
    parts = []
    for i in range(3):
        parts.append(
            f"""r{i} AS (SELECT adm2_name, CASE WHEN fold = {i} THEN 'test' WHEN row_number() OVER (PARTITION BY fold = {i} ORDER BY {hash_sql('42-val', str(i), 'adm2_name')}) - 1
                < ceil(0.2 * count(*) OVER (PARTITION BY fold = {i})) THEN 'val' ELSE 'train' END AS role_{i} FROM g)"""
        )
    return ", ".join(parts)


@query(
    "disjoint_fold_roles",
    ["ML-4"],
    f"""{oracle_views('clusters')}, {_RANKED}, g AS (SELECT adm2_name, CAST({even_part_sql('pos', 'n', '3')} AS INT) AS fold FROM k), {_disjoint_sql()}
        SELECT cluster, role_0, role_1, role_2 FROM clusters JOIN r0 USING (adm2_name) JOIN r1 USING (adm2_name) JOIN r2 USING (adm2_name)""",
)
def disjoint_fold_roles(t: Tables):
    return sp.disjoint_fold_roles(t.clusters, "adm2_name", 3).select("cluster", "role_0", "role_1", "role_2")


@query(
    "random_split",
    ["ML-5"],
    f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}) - 1 AS pos, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, 'split ' || (pos * 6 // n) AS split FROM k""",
)
def random_split(t: Tables):
    return sp.random_split(t.orders.select("o_orderkey"), ["o_orderkey"], 6)


@query("packed_split_sizes", ["ML-5"])
def packed_split_sizes(t: Tables):
    """Size and groups of every split when whole customers are packed largest first."""
    out = sp.packed_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 6)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("groups"))


@query("packed_split", ["ML-5"])
def packed_split(t: Tables):
    return sp.packed_split(t.clusters, "adm2_name", 6).select("cluster", "adm2_name", "split")


@query("year_disjoint_split", ["ML-5"])
def year_disjoint_split(t: Tables):
    return sp.year_disjoint_split(t.clusters, "adm1_name", "DHSYEAR", "adm0_name", 12).select("cluster", "split")


@query("mean_balanced_split", ["ML-5b"])
def mean_balanced_split(t: Tables):
    out = sp.mean_balanced_split(t.clusters, "adm2_name", "Actual", "adm0_name", k=5)
    return out.select("cluster", "adm2_name", "split")


@query("mean_balanced_year_split", ["ML-5b"])
def mean_balanced_year_split(t: Tables):
    out = sp.mean_balanced_split(t.clusters, "adm1_name", "Actual", "adm0_name", year="DHSYEAR", k=12)
    return out.select("cluster", "split")


def _balance(split, unit: str, year: str | None, value: str | None, spread: float):
    """One row: rows, rows without a split, splits, units with two years in one split, and whether sizes and means are even."""
    keys = [unit, year] if year else [unit]
    group = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("parts"))
    same = split.groupBy(unit, "split").agg(F.countDistinct(year or unit).alias("years"))
    per = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(value or F.lit(0.0)).alias("m"))
    whole = split.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("split").isNull()).alias("without"), F.stddev_samp(value or F.lit(0.0)).alias("s"))
    sizes = per.agg(F.count(F.lit(1)).alias("splits"), (F.max("n") - F.min("n")).alias("gap"), F.avg("n").alias("mean"), (F.max("m") - F.min("m")).alias("drift"))
    top = group.agg(F.max("n").alias("largest"), F.count_if(F.col("parts") > 1).alias("divided"))
    shared = same.agg(F.count_if(F.col("years") > 1).alias("shared"))
    one = whole.join(sizes, F.lit(True)).join(top, F.lit(True)).join(shared, F.lit(True))  # one row each
    return one.select(
        "rows", "without", "splits", "divided", "shared", (F.col("gap") <= F.greatest("largest", 0.1 * F.col("mean"))).alias("even_sizes"),
        (F.col("drift") <= spread * F.col("s")).alias("even_means") if value else F.lit(True).alias("even_means"),
    )


def _balance_sql(splits: int) -> str:
    return f"{oracle_views('clusters')} SELECT count(*) AS rows, 0 AS without, {splits} AS splits, 0 AS divided, 0 AS shared, TRUE AS even_sizes, TRUE AS even_means FROM clusters"


@query("year_disjoint_split_balance", ["ML-5"], _balance_sql(12))
def year_disjoint_split_balance(t: Tables):
    """No split holds two years of a unit, and sizes differ by a group or a tenth at most."""
    return _balance(sp.year_disjoint_split(t.clusters, "adm1_name", "DHSYEAR", "adm0_name", 12), "adm1_name", "DHSYEAR", None, 0)


@query("mean_balanced_split_balance", ["ML-5b"], _balance_sql(5))
def mean_balanced_split_balance(t: Tables):
    """Whole areas per split, sizes even, means within three tenths of a deviation."""
    return _balance(sp.mean_balanced_split(t.clusters, "adm2_name", "Actual", "adm0_name", k=5), "adm2_name", None, "Actual", 0.3)


@query("mean_balanced_year_split_balance", ["ML-5b"], _balance_sql(12))
def mean_balanced_year_split_balance(t: Tables):
    """As above, and no split holds two years of a unit; means of twelve splits lie within a deviation."""
    out = sp.mean_balanced_split(t.clusters, "adm1_name", "Actual", "adm0_name", year="DHSYEAR", k=12)
    return _balance(out, "adm1_name", "DHSYEAR", "Actual", 1.0)


_S = "'split ' || CAST(cluster % 7 AS VARCHAR)"


def _split7(t: Tables):
    return t.clusters.withColumn("split", F.concat(F.lit("split "), (F.col("cluster") % 7).cast("string")))


_SCORE = f"""s AS (SELECT *, {_S} AS split FROM clusters), w AS (SELECT avg(Actual) AS m, stddev_samp(Actual) AS sd FROM s),
    q AS (SELECT split, abs(any_value(w.m) - avg(Actual)) + abs(any_value(w.sd) - stddev_samp(Actual)) AS score FROM s, w GROUP BY split)"""


@query("split_scores", ["TK-3"], f"{oracle_views('clusters')}, {_SCORE} SELECT split, {r('score', 8)} AS score FROM q")
def split_scores(t: Tables):
    return rounded(sp.split_scores(_split7(t), "split", "Actual"), 8)


@query(
    "assigned_test_split",
    ["ML-5", "TK-3"],
    f"{oracle_views('clusters')}, {_SCORE} SELECT cluster, CASE WHEN split = (SELECT arg_min(split, (score, split)) FROM q) THEN 'test' ELSE split END AS split FROM s",
)
def assigned_test_split(t: Tables):
    return sp.assign_test(_split7(t), "split", "Actual").select("cluster", "split")


@query(
    "forced_test_split",
    ["ML-5"],
    f"{oracle_views('clusters')}, s AS (SELECT *, 'split ' || substr(adm1_name, 8) AS split FROM clusters) SELECT cluster, CASE WHEN split = (SELECT min(split) FROM s WHERE adm0_name = 'EUROPE') THEN 'test' ELSE split END AS split FROM s",
)
def forced_test_split(t: Tables):
    rows = t.clusters.withColumn("split", F.concat(F.lit("split "), F.expr("substring(adm1_name, 8)")))
    return sp.assign_test(rows, "split", "Actual", "adm0_name", "EUROPE").select("cluster", "split")


@query(
    "rotated_splits",
    ["ML-18"],
    f"{oracle_views('clusters')}, s AS (SELECT DISTINCT {_S} AS split FROM clusters) SELECT split AS test, COALESCE(lead(split) OVER (ORDER BY split), (SELECT min(split) FROM s)) AS val FROM s",
)
def rotated_splits(t: Tables):
    return sp.rotations(_split7(t), "split")


@query(
    "best_represented_splits",
    ["ML-18", "TK-3"],
    f"{oracle_views('clusters')}, {_SCORE}, k AS (SELECT split, row_number() OVER (ORDER BY score, split) AS i FROM q) SELECT max(CASE WHEN i = 1 THEN split END) AS test, max(CASE WHEN i = 2 THEN split END) AS val FROM k",
)
def best_represented_splits(t: Tables):
    return sp.best_represented(_split7(t), "split", "Actual")


@query(
    "train_val_test",
    ["ML-20"],
    f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}) - 1 AS pos, count(*) OVER () AS n FROM orders),
        z AS (SELECT *, CAST(floor(0.8 * n) AS BIGINT) AS a FROM k)
        SELECT o_orderkey, CASE WHEN pos < a THEN 'train' WHEN pos < a + floor(0.5 * (n - a)) THEN 'val' ELSE 'test' END AS split FROM z""",
)
def train_val_test(t: Tables):
    return sp.train_val_test(t.orders.select("o_orderkey"), ["o_orderkey"])


@query(
    "prepared_regression_labels",
    ["ML-22", "PF-13", "SF-29"],
    f"""{oracle_views('clusters')}, a AS (SELECT cluster, {_S} AS split, -Actual AS y FROM clusters), m AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM a),
        k AS (SELECT cluster, split, y FROM a, m WHERE y <= m + 2 * s AND y >= m - 2 * s), z AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM k)
        SELECT cluster, split, {r('(y - m) / s', 8)} AS label FROM k, z""",
)
def prepared_regression_labels(t: Tables):
    from surveyspark.operators.evaluate import prepare_regression_labels

    rows, _, _ = prepare_regression_labels(_split7(t), "Actual", "split", reverse=True, low=2, high=2, drop=True, normalise="Z")
    return rounded(rows.select("cluster", "split", "label"), 8)


_DRIFT_SQL = f"""{oracle_views('clusters')}, a AS (SELECT {_S} AS split, Actual AS x FROM clusters),
    w AS (SELECT count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, skewness(x) AS k, kurtosis(x) AS q FROM a),
    g AS (SELECT split, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, skewness(x) AS k, kurtosis(x) AS q FROM a GROUP BY split),
    d AS (SELECT split AS slice, g.n / w.n AS share, abs(g.m - w.m) AS md, abs(g.s - w.s) AS sd, abs(g.k - w.k) AS kd, abs(g.q - w.q) AS qd FROM g, w)
    SELECT slice, {r('share')} AS share, {r('md')} AS mean_diff, {r('sd')} AS std_diff, concat_ws(',', CASE WHEN md > 0.05 THEN 'mean' END, CASE WHEN sd > 0.1 THEN 'std' END,
      CASE WHEN kd > 0.1 THEN 'skew' END, CASE WHEN qd > 0.1 THEN 'kurtosis' END, CASE WHEN share <= 0.08 OR share >= 0.22 THEN 'size' END) AS warnings FROM d"""


@query("split_drift", ["ML-22", "AG-30"], _DRIFT_SQL)
def split_drift(t: Tables):
    from surveyspark.operators.aggregates import split_statistics
    from surveyspark.operators.evaluate import split_drift as drift

    out = drift(split_statistics(_split7(t), "split", "Actual"))
    return rounded(out.select("slice", "share", "mean_diff", "std_diff", "warnings"))
