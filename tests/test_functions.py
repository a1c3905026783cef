from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.functions import calendar as cal
from surveyspark.functions import geo
from surveyspark.functions import recode as rc
from surveyspark.functions import text as tx
from surveyspark.functions.similarity import word_similarity
from surveyspark.operators import dictionary as dc


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def one(spark, text, fn):
    return values(spark, [(text,)], "s string", fn("s"))[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Source (main) of water", "Source  of water".replace("  ", " ")),
        ("cs - has: radio/tv", "radio tv"),
        ("don't know", "don't know"),
        ("a [b] c", "a c"),
        ("x - y - z", "y z"),
    ],
)
def test_normalise_label(spark, text, want):
    assert one(spark, text, lambda c: tx.normalise_label(c, question=True)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("has the radio", "radio"), ("the of", "the of"), ("radio radio tv", "radio tv"), ("the", "the"), ("", "")],
)
def test_stop_words(spark, text, want):
    assert one(spark, text, tx.remove_stop_words) == want


@pytest.mark.parametrize(
    ("answer", "question", "want"),
    [
        ("95 or more", "hectares", 95.0), ("more than 2 years", "age in months", 24.0), ("more than 2 years", "age", None),
        ("less than one km", "distance in kilometres km", 1.0), ("3 or more visits", "number of visits", None), ("1,000+", "x", 1000.0),
        ("twelve or more", "x", None), ("7", "x", None),
    ],
)
def test_quantity_answer(spark, answer, question, want):
    got = values(spark, [(answer, question)], "a string, q string", tx.quantity_answer("a", "q"))[0]
    assert got == want


def test_numeric_answer_needs_numbers_in_the_column(spark):
    rows = [("none", True, False), ("none", True, True), ("5 ", True, False), ("5", False, False)]
    got = values(spark, rows, "a string, n boolean, y boolean", tx.numeric_answer("a", F.lit("x"), F.col("n"), F.col("y")))
    assert got == [0.0, None, 5.0, None]


def test_autocorrect(spark):
    rows = [("c", "1: yes", 1, False), ("c", "1: ", 2, False), ("c", "8: dk", 3, False), ("c", "9: ", 4, False), ("d", "95: 95 or more", 1, True)]
    out = {r["answer"]: r["corrected"] for r in tx.autocorrect(spark.createDataFrame(rows, "column string, answer string, position int, has_numbers boolean")).collect()}
    assert out == {"1: ": "yes", "8: dk": "don't know", "9: ": "9.0", "95: 95 or more": "95.0"}


@pytest.mark.parametrize(("x", "want"), [(1.23456, "1.2345"), (-0.5, "-0.5000"), (12.0, "12.0000"), (-33.99999, "-33.9999"), (0.00012, "0.0001"), (0.00005, "0.0001")])
def test_truncate(spark, x, want):
    assert values(spark, [(x,)], "x double", tx.truncate_decimal("x", 4))[0] == want


def test_file_names(spark):
    assert one(spark, "a b/c.tif", tx.sanitise_file_name) == "a_b_c.tif"
    assert one(spark, "a_b_c", lambda c: tx.replace_last(c, "_", ": ")) == "a_b: c"
    assert one(spark, "abc", lambda c: tx.replace_last(c, "_", ": ")) == "abc"
    survey, cluster = tx.tile_survey_cluster("s")
    df = spark.createDataFrame([("BFGE71FL00000203.tif",), ("BFGE71FL00000000.tif",)], "s string")
    assert [tuple(r) for r in df.select(survey, cluster).collect()] == [("BFGE71FL", 203), ("BFGE71FL", 0)]


def test_water_rules(spark):
    rows = [("unprotected well",), ("open public well",), ("neighbor's tap",), ("tanker truck",), (None,), ("rainwater",), ("bottled water",)]
    assert values(spark, rows, "s string", rc.simplify_source("s")) == [
        "unprotected well", "unprotected well", "piped to neighbor", "street vendor", None, "rainwater", "bottled",
    ]
    rows = [("piped to yard/plot",), ("tube well or borehole",), ("public tap/standpipe",), ("rainwater",)]
    assert values(spark, rows, "s string", rc.source_category("s", "piped3")) == ["piped to yard/plot", "groundwater", "piped (public/neighbor)", "other"]
    assert values(spark, rows, "s string", rc.source_category("s", "piped2")) == ["piped to yard/plot", "groundwater", "public tap/standpipe", "other"]


def test_time_and_place(spark):
    rows = [(None, "piped into dwelling"), (None, "rainwater"), ("on premises", "sachet"), ("on premises", "protected well"), ("15", "other")]
    df = spark.createDataFrame(rows, "t string, s string").withColumn("f", rc.fetch_time("t", "s"))
    assert [r["f"] for r in df.collect()] == [0.0, None, 5.0, 1.0, 15.0]
    place = df.select(rc.source_location(F.lit(None).cast("string"), "s", "f").alias("p"))
    assert [r["p"] for r in place.collect()] == ["in own dwelling", "elsewhere", "elsewhere", None, "elsewhere"]


def test_fill_water_answers_in_order(spark):
    cols = "`source of drinking water` string, `location of source for water` string, `time to get to water source (minutes)` double"
    rows = [("piped into dwelling", None, None), ("public well in yard", None, None), ("well", None, 0.0), ("well", None, 4.0), ("well", None, None), (None, None, None), ("well", "elsewhere", 3.0)]
    got = [tuple(r)[1:] for r in rc.fill_water_answers(spark.createDataFrame(rows, cols)).collect()]
    assert got == [
        ("in own dwelling", 0.0), ("elsewhere", None), ("in own yard/plot", 1.0), ("elsewhere", 4.0), ("in own yard/plot", 1.0), (None, None), ("elsewhere", 3.0),
    ]


def test_buckets_leave_gaps_unless_half_open(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (5.0,), (5.5,), (200.0,)], "m double")
    label, rank = rc.inclusive_buckets("m", rc.DISTANCE_LIMITS)
    assert [tuple(r) for r in df.select(label, rank).collect()] == [("0 - 0 mins", 0), (None, None), ("1 - 5 mins", -1), (None, None), ("121 - 999 mins", -6)]
    label, _ = rc.inclusive_buckets("m", rc.DISTANCE_LIMITS, half_open=True)
    assert [r[0] for r in df.select(label).collect()][1] == "1 - 5 mins"


def test_mapping_steps_and_rare_answers(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("don't know",)], "q string")
    m = spark.createDataFrame([("q", 1, "a", "b"), ("q", 2, "b", "z"), ("other", 1, "c", "x")], "column string, step int, from string, to string")
    out = sorted((r[0] or "") for r in rc.apply_mapping(df, m, ["q"], 2).collect())
    assert out == ["", "c", "don't know", "z", "z"]
    assert rc.drop_rare_answer(df, ["q"], below_percent=50).filter("q = \"don't know\"").count() == 0
    assert rc.drop_rare_answer(df, ["q"], below_percent=5).filter("q = \"don't know\"").count() == 1


def test_dates(spark):
    df = spark.createDataFrame([(2000, 1, 1), (2013, 13, 5), (1999, 4, 22)], "y int, m int, d int")
    got = [r[0] for r in df.select(cal.ethiopian_to_gregorian("y", "m", "d")).collect()]
    assert got[0] == datetime.date(2007, 9, 12) and got[1] == datetime.date(2021, 9, 10)
    df = spark.createDataFrame([(2010, 2, 31), (2010, None, 3)], "y int, m int, d int")
    assert [r[0] for r in df.select(cal.survey_date("y", "m", "d")).collect()] == [datetime.date(2010, 2, 28), None]
    assert one(spark, "97", cal.full_year) == 1997 and one(spark, "2003", cal.full_year) == 2003
    assert one(spark, "March", cal.month_number) == 3 and one(spark, "500 +", cal.minutes) == 500.0


def test_geometry(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"),
        geo.ring_area(F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 3D), named_struct('x', 0D, 'y', 3D))")).alias("a"),
        geo.ring_area(geo.project_ring(F.expr("array(named_struct('x', 30D, 'y', 0D), named_struct('x', 31D, 'y', 0D), named_struct('x', 31D, 'y', 1D), named_struct('x', 30D, 'y', 1D))"))).alias("p"),
    ).first()
    assert row["d"] == pytest.approx(111.19, abs=0.01) and row["a"] == 6.0
    assert row["p"] / 1e6 == pytest.approx(12309, rel=2e-3)  # one square degree at the equator


def test_word_similarity():
    eye = np.eye(4)
    same = word_similarity(["public", "well"], ["public", "well"], eye[:2], eye[:2], np.ones(4), np.ones(4))
    assert same[0] == pytest.approx(100.0) and same[2]
    longer = word_similarity(["public", "well"], ["well"], eye[:2], eye[1:2], np.ones(4), np.ones(4))
    assert longer[0] == pytest.approx(97.5)
    negated = word_similarity(["not", "well"], ["well"], eye[:2], eye[1:2], np.ones(4), np.ones(4))
    assert negated[0] == pytest.approx(92.5)
    legacy = word_similarity(["not", "well"], ["well"], eye[:2], eye[1:2], np.ones(4), np.ones(4), compare_negation=False)
    assert legacy[0] == pytest.approx(97.5)


def test_numbers_that_are_keys(spark):
    v = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "x"), ("b", "1"), ("b", "7"), ("c", "9")], "column string, value string")
    k = spark.createDataFrame([(c, float(i), f"answer {i}") for c in "abc" for i in (1, 2)], "column string, key double, label string")
    got = {r["column"]: r["decision"] for r in dc.numbers_as_keys(v, k).collect()}
    assert got == {"a": "True", "b": "Maybe", "c": "False"}
    assert {(r["column"], r["from"], r["to"]) for r in dc.key_mapping(v, k).collect()} == {("a", "1", "answer 1"), ("a", "2", "answer 2"), ("b", "1", "answer 1")}


def test_yes_no_direction(spark):
    rows = [("n", x) for x in ("0", "1", "1", "1", "1: yes")] + [("t", x) for x in ("0", "1", "yes", "yes", "no")] + [("two", x) for x in ("0", "1", "2", "yes", "yes", "yes", "yes")]
    got = {(r["column"], r["from"], r["to"]) for r in dc.yes_no_mapping(spark.createDataFrame(rows, "column string, value string")).collect()}
    assert got == {("n", "1: yes", "1"), ("t", "1", "yes"), ("t", "0", "no"), ("two", "yes", "1")}


def test_brackets_in_any_order(spark):
    rows = [("a (b) c", "a  c"), ("a) b (c", "a) b  b (c"), ("x) (a) y ( z", "x)  y ( z"), ("(", "("), ("(a) [b\nc] d", "  d"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("got", tx.drop_brackets("t")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
