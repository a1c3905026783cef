from __future__ import annotations

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import aggregates as ag
from surveyspark.operators import clustering as cl
from surveyspark.operators import evaluate as ev
from surveyspark.operators import impute as im
from surveyspark.operators import integration as ig
from surveyspark.operators import joins as jn
from surveyspark.operators import matching as mt
from surveyspark.operators import models as md
from surveyspark.operators import overlay as ov
from surveyspark.operators import positions as po
from surveyspark.operators import quality as ql
from surveyspark.operators import raster as rs
from surveyspark.operators import sets as st
from surveyspark.operators import splits as sp
from surveyspark.operators import transforms as tf
from surveyspark.operators import windows as wn


# --- aggregates ---------------------------------------------------------------------------


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "x": rng.gamma(2, size=300)})
    pdf.loc[len(pdf)] = ["single", 1.0]
    got = ag.moments_by(spark.createDataFrame(pdf), ["k"], "x").toPandas().set_index("k")
    g = pdf.groupby("k")["x"]
    for name, want in {"mean": g.mean(), "median": g.median(), "std": g.std(), "skewness": g.skew(), "kurtosis": g.apply(pd.Series.kurt)}.items():
        assert np.allclose(got[name].astype(float).sort_index(), want.sort_index(), equal_nan=True), name


def test_grouped_feature_table_by_hand(spark):
    rows = [("g", 1.0, "yes"), ("g", 2.0, None), ("g", 4.0, "yes"), ("g", None, "no"), ("h", 3.0, None), (None, 9.0, "yes")]
    df = spark.createDataFrame(rows, "k string, x double, c string")
    a = ag.grouped_feature_table(df, ["k"], ["x"], {"c": ["yes", "no"]}).orderBy("k").collect()
    assert [r["k"] for r in a] == ["g", "h"]
    assert a[0]["x_median"] == 2.0 and a[0]["x_valid_percent"] == 75.0 and a[0]["households"] == 4
    assert a[0]["DHS Cat; c: yes"] == pytest.approx(2 / 3) and a[0]["DHS Cat; c: NaN"] == 0.25
    assert a[1]["DHS Cat; c: yes"] is None and a[1]["DHS Cat; c: NaN"] == 1.0


def test_share_long_and_wide_agree(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b"), ("g", None), ("h", None)], "k string, c string")
    shares = ag.category_shares(df, ["k"], ["c"])
    sums = {r["k"]: r["s"] for r in shares.filter("category <> 'NaN'").groupBy("k").agg(F.sum("share").alias("s")).collect()}
    assert sums == {"g": pytest.approx(1.0)}
    wide = {r["k"]: r for r in ag.shares_wide(shares, ["k"], {"c": ["a", "b", "z"]}).collect()}
    direct = {r["k"]: r for r in df.groupBy("k").agg(*ag.share_columns({"c": ["a", "b", "z"]})).collect()}
    for k in wide:
        for c in wide[k].__fields__:
            assert wide[k][c] == direct[k][c] or wide[k][c] == pytest.approx(direct[k][c])


def test_majority_tie_is_alphabetical(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None)], "k string, c string")
    r = ag.majority(df, ["k"], "c").first()
    assert (r["c_max"], r["c_perc_max"]) == ("a", 50.0)


def test_weighted_mean_poisoned_by_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", None, 1.0), ("b", 2.0, 1.0)], "k string, x double, w double")
    got = {r["k"]: (r["p"], r["m"], r["s"]) for r in df.groupBy("k").agg(
        ag.weighted_mean(F.col("x"), F.col("w"), True).alias("p"), ag.weighted_mean(F.col("x"), F.col("w")).alias("m"), ag.weighted_std(F.col("x"), F.col("w")).alias("s")
    ).collect()}
    assert got["a"] == (2.5, 2.5, pytest.approx(math.sqrt(0.75))) and got["b"][:2] == (None, 2.0)


def test_weighted_variance_far_from_zero(spark):
    rows = [(off, off + x, w) for off in (0.0, 1e8, 1.6e9) for x, w in ((0.0, 1.0), (1.0, 2.0), (2.0, 5.0), (7.0, 0.5))]
    df = spark.createDataFrame(rows + [(3.0, None, 1.0), (3.0, 4.0, None), (4.0, 1.0, 0.0)], "k double, x double, w double")
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(ag.weighted_variance(F.col("x"), F.col("w")).alias("v")).collect()}
    x, w = np.array([0, 1, 2, 7.0]), np.array([1, 2, 5, 0.5])
    want = np.average((x - np.average(x, weights=w)) ** 2, weights=w)
    assert got[0.0] == pytest.approx(want) and got[1e8] == pytest.approx(want, rel=1e-6) and got[1.6e9] == pytest.approx(want, rel=1e-5)
    assert got[3.0] is None and got[4.0] is None


def test_regression_metrics_on_fixture(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, 2.5, 2.5, 4.0, 5.0, 8.0])), "a double, p double")
    r = df.agg(*ag.regression_metrics("a", "p")).first()
    a, p = np.arange(1, 7.0), np.array([1, 2.5, 2.5, 4, 5, 8])
    slope, icept = np.polyfit(a, p, 1)
    assert (r["slope"], r["intercept"]) == (pytest.approx(slope), pytest.approx(icept))
    assert r["r2"] == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, p double").agg(*ag.regression_metrics("a", "p")).first()
    assert flat["pearson"] is None and flat["r2"] is None


def test_profile_skips_only_the_empty_column(spark):
    df = spark.createDataFrame([("1", None, 7, "s"), ("x", None, 6, "s"), ("2", None, 7, "t")], "a string, b string, v int, s string")
    got = ag.profile_columns(df, ["a", "b"], "v", "s").collect()
    assert [r["column"] for r in got] == ["a"]
    assert got[0]["data_type"] == "mixed" and got[0]["mean"] == 1.5 and got[0]["available_recent"] == 2


def test_merged_counts_keep_their_mass(spark):
    vc = spark.createDataFrame([("a", 60.0), ("b", 30.0), ("c", 10.0)], "answer string, percent double")
    m = spark.createDataFrame([("c", "a")], "from string, to string")
    assert {r["answer"]: r["percent"] for r in ag.merge_value_counts(vc, m).collect()} == {"a": 70.0, "b": 30.0}


def test_integration_decision_text(spark):
    row = {
        "different": F.lit(0.0), "overwriting": F.lit(12.5), "name_similarity": F.lit(84.0), "answer_similarity": F.lit(91.0),
        "type_similarity": F.lit("Maybe"), "number_similarity": F.lit("True"), "integrated_overwriting": F.lit(None).cast("double"),
        "integrated_different": F.lit(None).cast("double"),
    }
    text = spark.range(1).select(ag.integration_decision(row)).first()[0]
    assert text.startswith("True? DT ? Maybe!?? Cosine str similarity of answers (indicator, %): Probably, 91.0% ")
    assert "Caution! Overwriting: 12.5 diff values: 0.0" in text and text.endswith("-- Caution! datatype similarity: Maybe")


# --- quality ------------------------------------------------------------------------------


def test_redundant_categories():
    known = {"DHS Cat; tv: yes": 5, "DHS Cat; tv: no": 5, "DHS Cat; lone: x": 5, "DHS Cat; two: a": 2, "DHS Cat; two: b": 4, "DHS Cat; lone: NaN": 5}
    assert ql.redundant_categories(list(known), known) == ["DHS Cat; tv: no", "DHS Cat; lone: x", "DHS Cat; two: a"]


def test_feature_names():
    names = [
        "Meta; year", "Meta; note", "DHS Num; a: mean", "DHS Num; a: median", "FS; IPC: 0-2y: mean", "FS; IPC: 1-2y: mean", "FS; IPC: 0-2y: max",
        "FS; IPC + FH: 0-2y: mean", "DHS Cat; region: x", "DHS Cat; q: NaN", "DHS Cat; q: y", "DHS Cat; native language: z", "DHS Education; e",
    ]
    assert ql.feature_names(names, ql.FeatureOptions(drop_meta=True)) == ["Meta; year", "DHS Num; a: mean", "FS; IPC: 0-2y: mean", "DHS Cat; q: y", "DHS Education; e"]
    assert ql.feature_names(names, ql.FeatureOptions(only_datasets=["FS"], keep_spans="fine", keep_areas=[])) == ["Meta; year", "FS; IPC: 1-2y: mean"]
    with pytest.raises(ValueError):
        ql.feature_names(names, ql.FeatureOptions(only_datasets=["none"]))


def test_correlated_columns_keep_the_fullest(spark):
    x = np.arange(50.0)
    pdf = pd.DataFrame({"a": x, "b": 2 * x + 1, "c": np.sin(x)})
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("a") > 3, F.col("a")))
    assert ql.drop_correlated(df, 0.95).columns == ["b", "c"]
    got = {(r["a"], r["b"]): r["corr"] for r in ql.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("b", "c")] == pytest.approx(pdf["b"].corr(pdf["c"]))


def test_sigma_and_outliers(spark):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 1.2)] * 10 + [("c", 9.0)], "g string, x double")
    assert ql.drop_outlier_groups(df, "g", "x", 1.0).select("g").distinct().count() == 2
    assert ql.trim_sigma(df, "x", 3.5, 3.5).count() == 20
    top = ql.clip_sigma(df, "x", high=2).agg(F.max("x")).first()[0]
    xs = np.array([1.0] * 10 + [1.2] * 10 + [9.0])
    assert top == pytest.approx(xs.mean() + 2 * xs.std(ddof=1))


def test_require_unique_fails_on_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        ql.require_unique(df, ["k"]).collect()
    assert ql.require_unique(df.distinct(), ["k"]).count() == 2


def test_numbered_names():
    assert ql.numbered_names(["a", "b", "a", "a"], 2) == (["a", "b", "a_Nr2", "a_Nr3"], ["a_Nr3"])


# --- windows ------------------------------------------------------------------------------


def test_weights_fixture(spark):
    rows = [("hello", 1, 2, "a"), ("hello", 2, 2, "a"), ("how", 3, 3, "a"), ("are", 4, 1, "b"), ("how", 5, 3, "a"), ("how", 6, 3, "a")]
    df = spark.createDataFrame(rows, "col1 string, col2 int, col3 int, col4 string")
    out = wn.weight_share(df, ["col1"], "col3").withColumn("w", F.col("col2") * F.col("share")).groupBy("col1").agg(F.sum("w").alias("w"))
    assert {r["col1"]: round(r["w"], 6) for r in out.collect()} == {"hello": 1.5, "how": 4.666667, "are": 4.0}


def test_rolling_pearson_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"p": range(80), "a": rng.random(80), "b": rng.random(80)})
    pdf.loc[20:26, "a"] = 0.5
    got = wn.rolling_pearson(spark.createDataFrame(pdf), [], "p", "a", "b", 4, block=9).orderBy("p").toPandas()["rolling_r"]
    want = pdf["a"].rolling(4, center=True).corr(pdf["b"]).replace([np.inf, -np.inf], np.nan)
    want[(pdf["a"].rolling(4, center=True).std() < 1e-12)] = np.nan
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_interpolation_matches_pandas(spark):
    y = pd.Series([np.nan, 1.0, np.nan, np.nan, 4.0, np.nan])
    df = spark.createDataFrame(pd.DataFrame({"p": range(6), "y": y})).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = [r["y"] for r in wn.interpolate(df, [], "p", "y", block=2).orderBy("p").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_group_filters(spark):
    df = spark.createDataFrame([(1, "U"), (1, "R"), (2, "R"), (2, "R"), (3, "U")], "k int, u string")
    assert sorted(r["k"] for r in wn.groups_with(df, ["k"], 2, any_flag=F.col("u") == "U").collect()) == [1, 1]
    assert [r["k"] for r in wn.groups_with(df, ["k"], 1, 1).collect()] == [3]


# --- joins --------------------------------------------------------------------------------


@pytest.mark.parametrize("day", [1, 2, 28])
def test_interval_aggregate_against_pandas(spark, day):
    months = pd.date_range("2008-01-01", "2013-12-01", freq="MS")
    panel = pd.DataFrame({"adm": "x", "date": [d.date() for d in months], "v": np.arange(len(months)) % 7 + 1.0})
    anchor = datetime.date(2010, 3, day)
    anchors = spark.createDataFrame([("x", anchor), ("y", anchor)], "adm string, date date")
    spans = [(0, 5, "m"), (-6, 2, "m"), (1, 2, "y"), (20, 25, "y")]
    out = jn.interval_aggregate(anchors, spark.createDataFrame(panel, "adm string, date date, v double"), ["adm"], "date", "date", {"v": "IPC"}, spans)
    rows = {r["adm"]: r for r in out.collect()}
    for s, e, u in spans:
        step = pd.DateOffset(months=1) if u == "m" else pd.DateOffset(years=1)
        lo, hi = pd.Timestamp(anchor) + s * step, pd.Timestamp(anchor) + e * step
        want = panel[(months >= lo) & (months < hi)]["v"]
        label = f"FS; IPC: {s}-{e}{u}"
        if len(want):
            assert rows["x"][f"{label}: mean"] == pytest.approx(want.mean()) and rows["x"][f"{label}: max"] == want.max()
            assert rows["x"][f"{label}: median"] == round(want.median(), 0)
        else:
            assert rows["x"][f"{label}: mean"] is None
        assert rows["y"][f"{label}: mean"] is None


def test_nearest_next_year_fixture(spark):
    pdf = pd.DataFrame({
        "clustered": [1, 1, 2, 2, 2, 1, 1, 2, 2, 2], "DHSYEAR": [2001, 2002, 2001, 2002, 2003, 2003, 2004, 2003, 2004, 2005],
        "LATNUM": [10.0, 12, 14, 16, 18, 12, 14, 16, 18, 20], "id": range(10),
    })
    pdf["LONGNUM"] = pdf["LATNUM"]
    got = {r["id"]: (r["next_id"], round(r["distance"], 3)) for r in jn.nearest_next_year(spark.createDataFrame(pdf), "clustered", "id", start_km=10.0).collect()}

    def hav(a, b):
        la, lo, lb, mo = map(math.radians, (a, a, b, b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
        return round(2 * 6371 * math.asin(math.sqrt(h)), 3)

    assert got == {
        0: (1, hav(10, 12)), 1: (5, 0.0), 5: (6, hav(12, 14)), 2: (3, hav(14, 16)), 3: (7, 0.0), 4: (8, 0.0), 7: (8, hav(16, 18)), 8: (9, hav(18, 20)),
    }


RINGS = "rings array<array<struct<x: double, y: double>>>"


def polygons(spark, name, rows):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in rows], f"{name} string, {RINGS}")


def whole_plane_area(a, b):
    """Area of two polygons' intersection by slabs over all their edges, without a grid."""
    from surveyspark.operators.overlay import shared_area

    def pieces(rings):
        return np.array([(*min(p, q), *max(p, q)) for r in rings for p, q in zip(r, [*r[1:], r[0]]) if p[0] != q[0]], dtype=float)

    return shared_area(pieces(a), None if b is None else pieces(b), -1e9)


def test_overlay_of_triangle_and_square(spark):
    areas = polygons(spark, "id", [("tri", [[(0, 0), (4, 0), (0, 4)]]), ("sq", [[(10, 0), (12, 0), (12, 2), (10, 2)]]), ("none", []), ("line", [[(0, 0), (1, 1)]])])
    zones = polygons(spark, "zone", [("z", [[(0, 0), (2, 0), (2, 4), (0, 4)]]), ("holed", [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]])])
    for tile in (None, 0.7, 2.0, 50.0):
        got = {(r["id"], r["zone"]): r for r in ov.overlay_ratio(areas, zones, "id", "zone", tile=tile, min_ratio=0.1).collect()}
        assert set(got) == {("tri", "z"), ("tri", "holed")}
        assert got["tri", "z"]["own"] == pytest.approx(8.0, abs=1e-9) and got["tri", "z"]["shared"] == pytest.approx(6.0, abs=1e-9)
        assert got["tri", "holed"]["shared"] == pytest.approx(6.0, abs=1e-9) and got["tri", "holed"]["area_ratio"] == pytest.approx(0.75, abs=1e-9)
    _, own = ov.overlay_areas(zones.withColumnRenamed("zone", "id"), zones, "id", "zone", 0.3)
    assert {r["id"]: round(r["own"], 9) for r in own.collect()} == {"z": 8.0, "holed": 12.0}


def test_overlay_of_concave_polygons_with_holes(spark):
    rng = np.random.default_rng(12)

    def star(x, y, size, n):
        turns = np.sort(rng.uniform(0, 2 * np.pi, n))
        return [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(turns, rng.uniform(0.4, 1, n) * size)]

    def shape(x, y, size):
        return [star(x, y, size, 14), [(x + 0.1 * size * c, y + 0.1 * size * s) for c, s in ((-1, -1), (1, -1), (1, 1), (-1, 1))]]

    left = [(f"a{i}", shape(*rng.uniform(-3, 3, 2), rng.uniform(0.5, 4))) for i in range(6)]
    right = [(f"z{i}", shape(*rng.uniform(-3, 3, 2), rng.uniform(0.5, 4))) for i in range(6)]
    for tile in (None, 0.45):
        shared, own = ov.overlay_areas(polygons(spark, "id", left), polygons(spark, "zone", right), "id", "zone", tile)
        got = {(r["id"], r["zone"]): r["shared"] for r in shared.collect()}
        for k, a in left:
            for m, z in right:
                assert got.get((k, m), 0.0) == pytest.approx(whole_plane_area(a, z), abs=1e-9)
        assert {r["id"]: pytest.approx(r["own"], abs=1e-9) for r in own.collect()} == {k: whole_plane_area(a, None) for k, a in left}
    assert whole_plane_area(right[0][1], None) > 0


def test_factorise_by_first_appearance(spark):
    df = spark.createDataFrame([("c", "t3"), ("a", "t1"), ("b", "t2"), ("a", "t9")], "s string, name string")
    assert {r["s"]: r["code"] for r in jn.factorise(df, "s", "name").collect()} == {"a": 0, "b": 1, "c": 2}


def test_set_cosine_join_is_exact(spark):
    rng = np.random.default_rng(2)
    sets = [sorted(rng.choice(list("abcdefgh"), size=rng.integers(1, 6), replace=False)) for _ in range(80)]
    df = spark.createDataFrame([(str(i), list(map(str, s))) for i, s in enumerate(sets)], "id string, tokens array<string>")
    ids = {r["id"]: r["sid"] for r in mt.set_ids(df, "id", "tokens").collect()}
    for t in (0.6, 0.85):
        got = {frozenset((r["l"], r["r"])) for r in mt.set_cosine_join(df, df, "id", "tokens", t, same=True).collect()}
        want = set()
        for i, j in itertools.combinations(range(80), 2):
            a, b = set(sets[i]), set(sets[j])
            if a != b and len(a & b) / math.sqrt(len(a) * len(b)) >= t - 1e-12:
                want.add(frozenset((ids[str(i)], ids[str(j)])))
        assert got == want


def test_unify_answers_follows_chains(spark):
    answers = spark.createDataFrame([("q", "well", 50.0), ("q", "wells", 0.3), ("q", "wels", 0.04), ("q", "tap", 49.66)], "column string, answer string, percent double")
    scores = spark.createDataFrame([("q", "well", "wells", 98.0, True), ("q", "wells", "wels", 99.0, True), ("q", "well", "tap", 20.0, True)], "column string, a string, b string, score double, matched boolean")
    mapping, shares = mt.unify_answers(answers, scores)
    assert {(r["from"], r["to"]) for r in mapping.collect()} == {("wells", "well"), ("wels", "well")}
    got = {r["answer"]: round(r["percent"], 2) for r in shares.collect()}
    assert got == {"well": 50.34, "tap": 49.66}


def test_integrate_columns(spark):
    rows = [("yes", "yes", None, "1"), ("no", None, "no", "2"), (None, "yes", None, None), ("yes", "yes", "no", None), ("no", "no", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    out = ig.integrate_columns(df, ["a", "b", "c", "d"], {("a", "b"): 99.0, ("a", "c"): 99.0, ("a", "d"): 50.0, ("b", "c"): 99.0, ("b", "d"): 50.0, ("c", "d"): 90.0}).collect()
    first = {r["column"]: r for r in out if r["round"] == 1}
    assert first["b"]["different"] == 0.0 and first["b"]["overwriting"] == 75.0 and first["b"]["decision"].startswith("True")
    assert first["c"]["different"] == 50.0 and first["c"]["integrated_overwriting"] == 100.0
    assert first["d"]["decision"].startswith("False: cosine similarity")
    assert max(r["round"] for r in out) == 3


# --- sets ---------------------------------------------------------------------------------


def test_common_columns_and_powerset(spark):
    cl_ = spark.createDataFrame([("s1", "A", "x"), ("s2", "B", "X"), ("s1", "C", "y")], "survey string, code string, label string")
    got = {r["label"]: (r["common"], r["codes"]) for r in st.common_columns(cl_).collect()}
    assert got == {"x": (True, ["A", "B"]), "y": (False, ["C"])}
    assert st.powerset(spark.createDataFrame([("a",), ("b",), ("c",)], "o string"), "o").count() == 8


# --- splits -------------------------------------------------------------------------------


def naive_packing(sizes, bins):
    loads = [0] * bins
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


@pytest.mark.parametrize("seed", range(4))
def test_packed_counts_equal_naive_packing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 1, 1, 2, 3, 7, 40, 500], size=300).tolist()
    hist = [(s, sizes.count(s)) for s in set(sizes)]
    plan = sp.packed_counts(hist, 5)
    loads = [sum(s * (b - a) for s, bin_, a, b in plan if bin_ == i) for i in range(5)]
    assert sorted(loads) == naive_packing(sizes, 5)
    for s, n in hist:
        spans = sorted((a, b) for size, _, a, b in plan if size == s)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_splits_keep_groups_together(spark):
    df = spark.range(2000).select(F.col("id").alias("row"), (F.col("id") % 37 + F.when(F.col("id") % 3 == 0, 100).otherwise(0)).alias("g"), F.rand(3).alias("y"))
    df = df.withColumn("g", F.when(F.col("row") % 3 == 1, 999).otherwise(F.col("g")))
    for out in (sp.packed_split(df, "g", 4), sp.mean_balanced_split(df.withColumn("c", F.lit("x")), "g", "y", "c", k=4)):
        assert out.filter("split IS NULL").count() == 0 and out.count() == 2000
        assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1


def test_folds_are_even_and_disjoint(spark):
    df = spark.range(23).select(F.col("id").alias("k"))
    sizes = sorted(r["count"] for r in sp.assign_folds(df, "k", 5).groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]
    assert sp.assign_folds(df, "k", -1).select("fold").distinct().count() == 23
    roles = sp.disjoint_fold_roles(df, "k", 3, 0.2).toPandas()
    for f in range(3):
        counts = roles[f"role_{f}"].value_counts()
        outside = 23 - counts["test"]
        assert counts["val"] == math.ceil(0.2 * outside)
    assert (roles[["role_0", "role_1", "role_2"]] == "test").sum(axis=1).eq(1).all()


def test_random_split_assigns_all_rows(spark):
    out = sp.random_split(spark.range(100), ["id"], 6).groupBy("split").count().collect()
    assert sum(r["count"] for r in out) == 100 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 1


@pytest.mark.parametrize("rounds", [0, 6])
def test_years_of_a_unit_never_share_a_split(spark, rounds):
    rng = np.random.default_rng(21)
    rows = []
    for u in range(60):
        for y in rng.choice(8, rng.integers(1, 7), replace=False):
            rows += [(f"u{u}", int(y), f"c{u % 7}", float(rng.normal(u % 5, 1)))] * int(rng.pareto(1.2) * 4 + 1)
    df = spark.createDataFrame(rows, "unit string, year int, country string, y double").unionByName(spark.createDataFrame([(None, 1, "x", 1.0)], "unit string, year int, country string, y double"))
    for out in (sp.year_disjoint_split(df, "unit", "year", "country", 6, rounds=rounds), sp.mean_balanced_split(df, "unit", "y", "country", "year", 6, rounds=rounds)):
        got = out.toPandas()
        assert got["split"].isna().sum() == 1 and len(got) == len(rows) + 1
        groups = got.dropna(subset=["split"]).groupby(["unit", "year"])["split"].nunique()
        assert (groups == 1).all()
        assert (got.dropna(subset=["split"]).groupby(["unit", "split"])["year"].nunique() == 1).all()
        sizes = got["split"].value_counts()
        if rounds:
            largest = pd.Series([r[:2] for r in rows]).value_counts().iloc[0]
            assert len(sizes) == 6 and sizes.max() - sizes.min() <= max(largest, 0.1 * sizes.mean())
    with pytest.raises(ValueError):
        sp.year_disjoint_split(df, "unit", "year", "country", 3)


def test_mean_balanced_split_is_even_in_mean_and_size(spark):
    rng = np.random.default_rng(22)
    rows = [(f"u{u}", float(rng.normal(u / 40, 0.3))) for u in range(200) for _ in range(int(rng.integers(5, 60)))]
    df = spark.createDataFrame(rows, "unit string, y double")
    got = sp.mean_balanced_split(df, "unit", "y", "unit", k=5).toPandas()
    means = got.groupby("split")["y"].mean()
    assert means.max() - means.min() < 0.25 * got["y"].std()
    sizes = got["split"].value_counts()
    assert (sizes.max() - sizes.min()) / sizes.mean() < 0.05


def test_even_moves_fill_half_the_gap():
    assert sp.even_moves([(0, 5, 3), (0, 2, 9), (1, 7, 1)], {0: 13.0, 1: 6.0}) == [(0, 5, 2), (0, 2, 1)]


def test_forced_test_split(spark):
    df = spark.createDataFrame([("s0", "MOZ", 1.0), ("s1", "KEN", 2.0), ("s0", "KEN", 1.0)], "split string, adm0_name string, y double")
    assert {r["split"] for r in sp.assign_test(df, "split", "y", "adm0_name", "MOZ").collect()} == {"test", "s1"}
    assert {r["split"] for r in sp.assign_test(df, "split", "y", "adm0_name", "MOZ", into=False).collect()} == {"test", "s0"}


# --- clustering ---------------------------------------------------------------------------


def brute_components(n, near):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_connected_components_on_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    got = {r["node"]: r["component"] for r in cl.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(400, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in nodes}


@pytest.mark.parametrize("task_edges", [po.TASK_EDGES, 0])
def test_position_clusters_against_brute_force(spark, task_edges):
    rng = np.random.default_rng(6)
    lat = np.concatenate([rng.normal(5, 0.02, 120), rng.uniform(-60, 60, 60), [0.0, 0.0, 89.99, 89.99], [5.0, 5.0]])
    lon = np.concatenate([rng.normal(9, 0.02, 120), rng.uniform(-180, 180, 60), [179.9999, -179.9999, 10.0, 170.0], [30.0, 30.0]])
    pdf = pd.DataFrame({"id": range(len(lat)), "LATNUM": lat, "LONGNUM": lon})
    km = 1.5
    la, lo = np.radians(lat), np.radians(lon)
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    want = brute_components(len(lat), [(i, j) for i, j in zip(*np.where(d <= km)) if i < j])
    sizes = pd.Series(want).value_counts()
    got = po.cluster_positions(spark.createDataFrame(pdf), ["id"], km, noise="grouped", noise_group=10, task_edges=task_edges).toPandas().set_index("id").sort_index()
    assert ((got["clustered"] == -1).to_numpy() == np.array([sizes[w] == 1 for w in want])).all()
    inside = got[got["clustered"] != -1]
    pairs = set(zip(inside["clustered"], [want[i] for i in inside.index]))
    assert len(pairs) == inside["clustered"].nunique() == len({want[i] for i in inside.index})
    lone = got[got["clustered"] == -1]["clustered: grouped non-clustered"]
    assert (lone < 0).all() and lone.value_counts().max() <= 10


def test_vector_clusters_do_not_depend_on_cells(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([c + rng.normal(0, 0.05, (40, 6)) for c in rng.normal(0, 1, (4, 6))] + [rng.normal(0, 2, (20, 6))])
    v = np.concatenate([v, v[:3]])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    d = np.linalg.norm(v[:, None] - v, axis=2)
    want = brute_components(len(v), [(i, j) for i, j in zip(*np.where(d <= 0.15)) if i < j])
    for max_cell, depth in ((2048, 8), (16, 2)):
        edges = cl.vector_near_pairs(df, "id", "v", 0.15, pivots=4, max_cell=max_cell, depth=depth)
        got = {r["node"]: r["component"] for r in cl.connected_components(edges).collect()}
        assert {i: got.get(i, i) for i in range(len(v))} == dict(enumerate(want))


def test_vector_cells_are_not_copied_where_no_pivot_tells_them_apart(spark, monkeypatch):
    """Directions in many dimensions are all about 1.4 apart: with steps of 0.95 every cell would hold every vector."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(420, 32))
    v[:60] = rng.normal(size=32) + rng.normal(0, 0.1, (60, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v[400:] = v[:20]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None)], "id long, v array<float>")
    d = np.linalg.norm(v[:, None].astype(float) - v.astype(float), axis=2)
    want = brute_components(len(v), [(i, j) for i, j in zip(*np.where(d <= 0.95)) if i < j])
    compared = []
    blocks = cl._block_edges
    monkeypatch.setattr(cl, "_block_edges", lambda cells, *a: (compared.append(cells.count()), blocks(cells, *a))[1])
    edges = cl.vector_near_pairs(df, "id", "v", 0.95, pivots=8, max_cell=32, depth=3)
    got = {r["node"]: r["component"] for r in cl.connected_components(edges).collect()}
    assert compared == [400]
    assert 900 not in got and {i: got.get(i, i) for i in range(len(v))} == dict(enumerate(want))


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-6, 0.0), (1.0, 1e6), (1e18, 0.0)])
def test_near_vectors_of_any_size_are_linked(scale, shift):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 5)) * scale + shift
    x[5, 2], x[6, 0] = np.nan, np.inf
    radius = 0.7 * scale
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = brute_components(len(x), [(i, j) for i, j in zip(*np.where(d <= radius)) if i < j])
    one = cl._Links(np.arange(len(x)))
    cl._link(x, one, range(len(x)), range(len(x)), radius)
    assert one.label.tolist() == list(want)
    two = cl._Links(np.arange(len(x)))
    for part in (range(300), range(300, len(x))):
        cl._link(x, two, part, part, radius)
    cl._link(x, two, range(300), range(300, len(x)), radius)
    assert two.label.tolist() == list(want)


# --- imputation and models ----------------------------------------------------------------


def test_knn_imputation_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(150), "a": rng.normal(size=150), "b": np.concatenate([rng.normal(size=75), rng.normal(5, 0.01, 75)]), "t": rng.normal(size=150)})
    gap = pdf["id"] % 4 == 0
    df = spark.createDataFrame(pdf).withColumn("t", F.when(F.col("id") % 4 != 0, F.col("t")))
    got = im.impute_knn(df, "id", "t", ["a", "b"], 5).toPandas().set_index("id").sort_index()["t"]
    z = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)).to_numpy()
    donors = np.flatnonzero(~gap)
    for i in np.flatnonzero(gap):
        near = donors[np.argsort(np.linalg.norm(z[donors] - z[i], axis=1), kind="stable")[:5]]
        assert got[i] == pytest.approx(pdf["t"][near].mean())


def test_knn_donors_of_equal_features_count_as_rows(spark):
    donors = spark.createDataFrame([(0.0, 1.0)] * 7 + [(1.0, 100.0)], "x double, v double")
    need = spark.createDataFrame([(1, 0.1)], "id int, x double")
    assert im.nearest_donors(need, donors, "id", ["x"], "v", k=5).first()["value"] == pytest.approx(1.0)


def test_chained_imputation_recovers_a_line(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": x, "y": 3 * x + 1, "z": rng.normal(size=200)}))
    holes = df.withColumn("y", F.when(F.col("id") % 5 != 0, F.col("y")))
    for estimator, tolerance in (("linear", 1e-6), ("bayesian", 1e-2)):
        got = im.impute_chained(holes, "id", ["x", "y", "z"], estimator, rounds=4).toPandas().sort_values("id")
        assert np.allclose(got["y"], 3 * x + 1, atol=tolerance)


def test_chained_imputation_far_from_zero(spark):
    x = 1.6e9 + np.arange(200) % 17
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "x": x, "y": 2 * x + 1}))
    holes = df.withColumn("y", F.when(F.col("id") % 5 != 0, F.col("y")))
    for estimator in ("linear", "bayesian"):
        got = im.impute_chained(holes, "id", ["x", "y"], estimator, rounds=2).toPandas().sort_values("id")
        assert np.allclose(got["y"], 2 * x + 1, rtol=0, atol=1e-2)


@pytest.mark.parametrize("depth", [1, 15])
def test_near_cells_of_every_level(spark, depth):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.uniform(0, 2, (150, 3)), rng.normal(0.5, 0.01, (50, 3))])
    points = spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz")))
    eps = [0.2, 0.05]
    side = [e / 3**0.5 * (1 - 1e-12) for e in eps]
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(e).alias("eps"), F.lit(s).alias("side")) for n, (e, s) in enumerate(zip(eps, side))])
    placed = points.withColumn("l", F.explode(levels)).select("x", "y", "z", "l.*").withColumn("cell", po._cell(F.col("side")))
    got = [tuple(tuple(p[t]) for t in "ab") for p in po.near_cells(placed, depth).collect()]
    assert len(got) == len(set(got))
    want = set()
    for n, (e, s) in enumerate(zip(eps, side)):
        cell = [(n, *(int(c) for c in np.floor(p / s))) for p in xyz]
        near = np.argwhere(np.linalg.norm(xyz[:, None] - xyz, axis=2) <= e)
        want |= {frozenset((cell[i], cell[k])) for i, k in near if cell[i] != cell[k]}
    assert {frozenset(p) for p in got} == want


def test_positions_at_many_radii(spark):
    rng = np.random.default_rng(16)
    lat = np.concatenate([rng.normal(5, 0.05, 150), rng.uniform(4, 6, 80), rng.uniform(-80, 80, 40), [10.0, 10.0]])
    lon = np.concatenate([rng.normal(9, 0.05, 150), rng.uniform(8, 10, 80), rng.uniform(-180, 180, 40), [50.0, 50.0]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(lat)), "LATNUM": lat, "LONGNUM": lon}))
    df = df.unionByName(spark.createDataFrame([(9999, None, 1.0)], "id long, LATNUM double, LONGNUM double"))
    la, lo = np.radians(lat), np.radians(lon)
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    got = po.position_levels(df, [0.5, 20.0, 3.0]).toPandas()
    assert len(got) == 3 * len(lat)
    for km, rows in got.groupby("distance"):
        want = pd.Series(brute_components(len(lat), [(i, k) for i, k in zip(*np.where(d <= km)) if i < k]))
        sizes = want.map(want.value_counts())
        rows = rows.set_index("id").sort_index()
        assert (rows["clustered"].isna() == (sizes == 1)).all()
        named = rows["clustered"].dropna().map(str)
        assert len(set(zip(named, want[named.index]))) == named.nunique() == want[named.index].nunique()


def test_hidden_values_and_rotation(spark):
    cols = ["DHS Num; a: mean", "DHS Cat; q: x", "DHS Cat; q: y"]
    assert im.rotated_columns(cols) == [["DHS Num; a: mean", "DHS Cat; q: x"], ["DHS Num; a: mean", "DHS Cat; q: y"]]
    df = spark.range(400).select(F.col("id").alias("k"), *[F.col("id").cast("double").alias(c) for c in cols])
    hid = im.hide_values(df, ["k"], cols, 0.2, together=True).toPandas()
    assert 40 < hid[cols[0]].isna().sum() < 120
    assert (hid[cols[1]].isna() == hid[cols[2]].isna()).all()


def test_components_of_groups_from_one_scan(spark):
    rng = np.random.default_rng(33)
    rows = []
    for key, shift in (("x", 0.0), ("y", 1e6), (None, -5.0)):
        base = rng.normal(size=60)
        rows += [(key, float(shift + b), float(2 * b + n), float(-b + m), float(b) if i % 9 else None) for i, (b, n, m) in enumerate(zip(base, rng.normal(size=60), rng.normal(size=60)))]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, o double").repartition(7)
    got = {r["key"]: r for r in md.grouped_components(df, ["a", "b", "c"], F.col("g"), "c").collect()}
    assert set(got) == {"x", "y", None}
    pdf = pd.DataFrame(rows, columns=["g", "a", "b", "c", "o"])
    for key, r in got.items():
        x = pdf[pdf.g.isna() if key is None else pdf.g == key][["a", "b", "c"]].to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        ev, vec = np.linalg.eigh(z.T @ z / len(z))
        want = vec[:, -1] * np.sign(np.corrcoef(z @ vec[:, -1], z[:, 2])[0, 1])
        assert r["n"] == 60 and np.allclose(r["weights"], want, atol=1e-6) and np.allclose(r["mean"], x.mean(axis=0)) and np.allclose(r["std"], x.std(axis=0))
    outside = md.grouped_components(df, ["a", "b"], F.col("g"), "o").collect()
    assert all(r["n"] == 60 - 7 for r in outside) and all(r["weights"][0] > 0 for r in outside)
    assert md.grouped_components(df.limit(0), ["a", "b"], F.col("g")).collect() == []


def test_pca_index_and_reduction(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=300)
    pdf = pd.DataFrame({"a": base + rng.normal(0, 0.1, 300), "b": -base + rng.normal(0, 0.1, 300), "c": rng.normal(0, 0.01, 300)})
    df = spark.createDataFrame(pdf)
    comp = md.principal_components(df, ["a", "b", "c"])
    z = (pdf - pdf.mean()) / pdf.std(ddof=0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z.T, ddof=0)))[::-1]
    assert np.allclose(comp.explained, ev / ev.sum())
    out = md.pca_index(df, ["a", "b"], "b").toPandas()
    assert np.corrcoef(out["index"], out["b"])[0, 1] > 0.9
    red, _ = md.pca_reduce(df, ["a", "b", "c"], 0.98)
    assert red.columns == ["pc0"]


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, 400), [14.0]])
    out = md.isolation_forest(spark.createDataFrame(pd.DataFrame({"id": range(401), "x": x})), "id", ["x"], trees=40, max_samples=128).toPandas()
    assert out.loc[out["anomaly_score"].idxmax(), "id"] == 400 and out["anomaly"].mean() < 0.35
    again = md.isolation_forest(spark.createDataFrame(pd.DataFrame({"id": range(401), "x": x})), "id", ["x"], trees=40, max_samples=128).toPandas()
    assert np.allclose(out.sort_values("id")["anomaly_score"], again.sort_values("id")["anomaly_score"])


def test_box_cox_power_of_log_normal(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame(pd.DataFrame({"x": np.exp(rng.normal(size=4000))}))
    s = tf.fit_scaling(df, "x", "boxcox", "Z")
    assert abs(s.power) < 0.05
    r = df.select(s.apply(F.col("x")).alias("y"), s.invert(s.apply(F.col("x"))).alias("b"), "x").agg(F.avg("y"), F.stddev_pop("y"), F.max(F.abs(F.col("b") - F.col("x")))).first()
    assert abs(r[0]) < 1e-9 and r[1] == pytest.approx(1.0) and r[2] < 1e-6


def test_label_codes(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 38 + [("c",)] * 2, "l string")
    got = {r["category"]: (r["code"], r["target"]) for r in md.label_codes(df, "l", 0.05, to_other=True).collect()}
    assert got == {"a": (0, "a"), "b": (1, "b"), "c": (None, "other")}
    assert {r["category"]: r["target"] for r in md.label_codes(df, "l", 0.05, replace={"c": "b"}).collect()}["c"] == "b"


# --- evaluation and raster ----------------------------------------------------------------


def predictions(spark):
    rng = np.random.default_rng(14)
    n = 300
    pdf = pd.DataFrame({
        "id": range(n), "adm0_name": rng.choice(["Mozambique", "Kenya"], n), "adm1_name": rng.choice(["n", "s"], n), "adm2_name": rng.choice(list("abcd"), n),
        "DHSYEAR": rng.integers(2012, 2019, n), "URBAN_RURA": rng.choice(["U", "R"], n), "households": rng.integers(5, 30, n), "Actual": rng.normal(size=n),
        "LATNUM": np.round(rng.uniform(0, 0.2, n), 3), "LONGNUM": np.round(rng.uniform(0, 0.2, n), 3),
    })
    pdf["Prediction"] = pdf["Actual"] * 0.7 + rng.normal(0, 0.3, n)
    return pdf, spark.createDataFrame(pdf)


def test_rollup_matches_pandas(spark):
    pdf, df = predictions(spark)
    got = ev.area_rollup(df).toPandas()
    keep = pdf[(pdf.Actual - pdf.Actual.mean()).abs() <= 2 * pdf.Actual.std()]
    want = keep[keep.URBAN_RURA == "U"].groupby(["adm1_name", "adm0_name", "DHSYEAR"]).agg(Actual=("Actual", "mean"), clusters=("id", "size"), hh=("households", "sum")).reset_index()
    mine = got[(got.sigma == "2") & (got.member == "Urban") & (got.level == "adm1") & got.by_year]
    m = mine.merge(want, on=["adm1_name", "adm0_name", "DHSYEAR"])
    assert len(m) == len(want) == len(mine)
    assert np.allclose(m["Actual_x"], m["Actual_y"]) and (m["clusters_x"] == m["clusters_y"]).all() and (m["households_sum"] == m["hh"]).all()


def test_report_names_and_values(spark):
    pdf, df = predictions(spark)
    rep = ev.slice_report(df, df, "Mozambique").toPandas().set_index("slice")
    sub = pdf[(pdf.URBAN_RURA == "R") & (pdf.DHSYEAR >= 2015)]
    assert rep.loc["Rural Since 2015 STD None", "rmse"] == pytest.approx(np.sqrt(((sub.Actual - sub.Prediction) ** 2).mean()))
    assert {"Test", "Val", "All adm2 Year Mozambique STD 3", "Urban adm1 STD 2", "All adm2 Year before 2015 STD None"} <= set(rep.index)
    row = ev.report_row(ev.slice_report(df, df, "Mozambique"), ["Test"], ["r2"]).first()
    assert row["Test r2"] == pytest.approx(rep.loc["Test", "r2"])


def test_cluster_evaluation_counts_every_row_once(spark):
    pdf, df = predictions(spark)
    out = {r["mode"]: r for r in ev.cluster_evaluation(df, [0.6]).collect()}
    assert set(out) == {"All", "U", "R", "U+R"}
    assert out["All"]["in_cluster_size"] + out["All"]["out_of_cluster_size"] == 300
    n_u = int((pdf.URBAN_RURA == "U").sum())
    assert out["U"]["in_cluster_size"] + out["U"]["out_of_cluster_size"] == n_u


def test_drift_warnings(spark):
    stats = spark.createDataFrame(
        [("whole ds", 100, 0.0, 1.0, 0.0, 0.0), ("test", 5, 0.2, 1.05, 0.0, 0.3), ("split 1", 20, 0.01, 1.0, 0.0, 0.0)],
        "slice string, size long, mean double, std double, skew double, kurtosis double",
    )
    assert {r["slice"]: r["warnings"] for r in ev.split_drift(stats).collect()} == {"test": "mean,kurtosis,size", "split 1": ""}


def test_tiles_match_numpy(spark):
    rng = np.random.default_rng(15)
    a = rng.normal(size=(2, 6, 8)).astype("float32")
    a[0, 1, 2] = np.nan
    rows = [(1, b, 6, 8, [float(v) for v in a[b].ravel()]) for b in range(2)]
    df = spark.createDataFrame(rows, "tile_id int, band int, height int, width int, px array<float>")

    def back(d):
        return {r["band"]: np.array(r["px"], dtype=float) for r in d.collect()}

    crop = back(rs.crop_centre(df, 4, 4))
    assert np.allclose(crop[1].reshape(4, 4), a[1, 1:5, 2:6])
    filled = back(rs.fill_unknown(df))
    assert np.allclose(filled[0], np.where(np.isnan(a[0]), np.nanmean(a[0]), a[0]).ravel(), atol=1e-6)
    clip = back(rs.clip_pixels(df, sigmas=1.0))
    assert np.allclose(clip[1], np.clip(a[1], a[1].mean() - a[1].std(), a[1].mean() + a[1].std()).ravel(), atol=1e-5)
    z = back(rs.normalise_tiles(df.filter("band = 1"), "Z local"))
    assert np.allclose(z[1], ((a[1] - a[1].mean()) / a[1].std()).ravel(), atol=1e-4)
    ledger = rs.nan_ledger(df).first()
    assert ledger["nan_percent"] == pytest.approx(100 / 96)
    with pytest.raises(Exception, match="tile too small"):
        rs.crop_centre(df, 10, 4).collect()


def test_tile_moments_keep_small_spreads_on_large_offsets(spark):
    from surveyspark.operators import raster as rs

    rows = [(1, 0, [1e8, 1e8 + 1, None]), (1, 1, [1e8 + 3.0, float("nan")]), (2, 0, [1e8 + 2.0, 1e8 + 4.0]), (2, 1, [1e8 + 8.0])]
    df = spark.createDataFrame(rows, "tile_id int, band int, px array<double>")
    got = {r["band"]: (r["mean"], r["std"]) for r in rs.corpus_statistics(df).collect()}
    for band, x in {0: [0, 1, 2, 4], 1: [3, 8]}.items():
        assert got[band] == pytest.approx((1e8 + np.mean(x), np.std(x)), rel=1e-9)
    files = {r["band"]: r["std"] for r in rs.corpus_statistics(df, per_file=True).collect()}
    assert files[0] == pytest.approx(np.sqrt(np.mean([0.25, 1.0]) + np.var([0.5, 3.0])))
    one = df.filter("tile_id = 1").groupBy("tile_id").agg(rs.joined_moments(F.collect_list(rs.pixel_moments(F.col("px")))).alias("t"))
    assert one.select(rs.std_of(F.col("t")).alias("s")).first()["s"] == pytest.approx(np.std([0, 1, 3]))
