from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspark.core import namespaces as ns
from surveyspark.core.bounded import collect_bounded
from surveyspark.core.hashing import HASH_SPAN, seeded_hash
from surveyspark.core.ordering import average_ranks, carry, column_medians, exact_quantiles, hash_positions, rolling, value_positions


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(6000) < 0.66, "hot", rng.choice(list("abcdef"), 6000)), "x": np.round(rng.normal(size=6000), 2)})
    pdf.loc[::97, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    return pdf, df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("ranges", [1, 16])
def test_quantiles_match_pandas(skewed, ranges):
    pdf, df = skewed
    got = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(df, ["k"], "x", {"a": 0.5, "b": 0.9}, ranges=ranges).collect()}
    for k, g in pdf.groupby("k"):
        want = g["x"].quantile([0.5, 0.9])
        assert got[k] == pytest.approx(tuple(want))


@pytest.mark.parametrize("ranges", [1, 16])
def test_positions_cover_every_row(skewed, ranges):
    pdf, df = skewed
    pos = value_positions(df, ["k"], "x", ranges=ranges).toPandas().sort_values(["k", "x"])
    for k, g in pos.groupby("k"):
        assert (g["before"].to_numpy() == np.concatenate([[0], g["n"].cumsum()[:-1]])).all()
        assert g["n"].sum() == pdf[pdf.k == k]["x"].count() == g["total"].iloc[0]


def test_global_positions_without_keys(skewed):
    pdf, df = skewed
    pos = value_positions(df, [], "x", ranges=25).toPandas().sort_values("x")
    assert (pos["before"].to_numpy() == np.concatenate([[0], pos["n"].cumsum()[:-1]])).all()


def test_column_medians_keep_every_group(spark, skewed):
    pdf, df = skewed
    got = column_medians(df, ["k"], ["x"]).toPandas().set_index("k")["x_median"]
    pd.testing.assert_series_equal(got.sort_index(), pdf.groupby("k")["x"].median(), check_names=False)
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, None), ("b", None, None), (None, 4.0, None)], "k string, x double, y double")
    got = {r["k"]: (r["x_median"], r["y_median"]) for r in column_medians(rows, ["k"], ["x", "y"]).collect()}
    assert got == {"a": (2.0, 5.0), "b": (None, None), None: (4.0, None)}


def test_average_ranks_match_pandas(skewed):
    pdf, df = skewed
    got = average_ranks(df.select("k", "x").distinct().union(df.select("k", "x")), ["k"], "x").groupBy("k", "x").agg(F.max("rank").alias("r")).toPandas()
    both = pd.concat([pdf.drop_duplicates(), pdf])
    want = both.assign(r=both.groupby("k")["x"].rank()).groupby(["k", "x"])["r"].max().reset_index()
    m = got.dropna().merge(want, on=["k", "x"])
    assert len(m) == len(want) and np.allclose(m["r_x"], m["r_y"])


def test_hash_positions_are_a_permutation(spark):
    df = spark.range(5000).withColumn("h", seeded_hash(1, "id"))
    pos = sorted(r["position"] for r in hash_positions(df, "h", HASH_SPAN, ranges=7).collect())
    assert pos == list(range(5000))


@pytest.mark.parametrize("block", [5, 4096])
def test_rolling_and_carry_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": ["u"] * 60 + ["v"] * 40, "p": list(range(60)) + list(range(40)), "y": rng.random(100)})
    pdf.loc[rng.random(100) < 0.5, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = rolling(df, ["g"], "p", 3, 2, {"s": lambda w: F.sum("y").over(w)}, block).toPandas().sort_values(["g", "p"])
    want = pd.concat([g["y"].fillna(0).rolling(6, min_periods=1).sum().shift(-2) for _, g in pdf.groupby("g")])
    mask = want.notna().to_numpy()
    assert np.allclose(got["s"].fillna(0).to_numpy()[mask], want.to_numpy()[mask])
    c = carry(df, ["g"], "p", "y", block).toPandas().sort_values(["g", "p"])
    for _, g in pdf.groupby("g"):
        mine = c[c.g == g["g"].iloc[0]]
        assert np.allclose(mine["prev_val"].astype(float), g["y"].ffill(), equal_nan=True)
        assert np.allclose(mine["next_val"].astype(float), g["y"].bfill(), equal_nan=True)


def test_names():
    f = ns.parse("DHS Num; source of water: mean")
    assert (f.dataset, f.question, f.stat) == ("DHS Num", "source of water", "mean")
    assert ns.build(ns.CATEGORICAL, "roof", "tin") == "DHS Cat; roof: tin"
    assert ns.parse("plain").dataset is None


def test_collect_bounded_refuses(spark):
    with pytest.raises(ValueError):
        collect_bounded(spark.range(5), 4, "rows")
    assert len(collect_bounded(spark.range(4), 4, "rows")) == 4
