from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from surveyspark.sources import files as fl
from surveyspark.sources import surveys as sv
from surveyspark.streaming.ingest import finished_files, ingest_new_files


def test_case_ids(spark):
    rows = [("  123 7", 123), ("00120034", None), ("  45 12", 312), ("99 3 8", 73), ("abc", 1)]
    df = spark.createDataFrame(rows, "c string, n int")
    c, h = sv.numbers_from_case(F.col("c"), F.col("n"))
    assert [tuple(r) for r in df.select(c, h).collect()] == [(123, 7), (12, 34), (312, None), (73, 8), (1, None)]


def test_renumbering_touches_only_surveys_with_duplicates(spark):
    cols = "survey string, `cluster number` string, `household number` string, `case identification` string"
    rows = [("A", "5", "1", "5 11"), ("A", "5", "1", "5 12"), ("B", "6", "1", "6 77")]
    got = {tuple(r) for r in sv.renumber_households(spark.createDataFrame(rows, cols)).select("survey", "household number", "generated hhnr from case id").collect()}
    assert got == {("A", 11, True), ("A", 12, True), ("B", 1, False)}


def test_decode_drops_null_tokens_and_fails_on_double_households(spark):
    raw = spark.createDataFrame([("1", "1", 0.0, "nan"), ("1", "2", 9.0, "tin")], "HV001 string, HV002 string, HV201 double, HV213 string")
    labels = {"HV001": "cluster number", "HV002": "household number", "HV201": "source", "HV213": "floor"}
    out = sv.decode_survey(raw, "KEHR4A", labels, {"HV201": {0.0: "Well"}}, ["source", "floor"], make_ids=True).orderBy("`DHSID + HHID`").collect()
    assert [(r["source"], r["floor"]) for r in out] == [("0: well", None), ("9.0", "tin")]
    assert out[0]["DHSID + HHID"] == "KEHR4A0000000100000001"
    twice = spark.createDataFrame([("1", "1"), ("1", "1")], "HV001 string, HV002 string")
    with pytest.raises(Exception, match="duplicate key"):
        sv.decode_survey(twice, "KEHR4A", labels, {}, ["source"], make_ids=True).collect()


def test_version_falls_back_to_the_folder(spark):
    df = spark.createDataFrame([("KE7", "KEHR4A"), ("KEx", "KEHR4A")], "`country code and phase` string, survey string")
    assert [tuple(r) for r in sv.with_version(df).select("version_nr", "subversion_nr").collect()] == [(7, "A"), (4, "A")]


def test_counterparts(spark):
    s = spark.createDataFrame([("KEHR71",), ("KEHR7A",), ("TZHR41",)], "survey string")
    loc = spark.createDataFrame([("KEGE72FL",), ("KEGE7BFL",), ("KEGE7CFLX",), ("TZHR41FL",)], "location string")
    got = {r["survey"]: r["location"] for r in sv.location_counterparts(s, loc).collect()}
    assert got == {"KEHR71": "KEGE72FL", "KEHR7A": "KEGE7BFL", "TZHR41": None}
    with pytest.raises(Exception, match="no single location survey"):
        sv.location_counterparts(s, loc.union(spark.createDataFrame([("KEGE7DFL",)], "location string"))).collect()


def test_labels_and_picking():
    assert sv.label_of("HHID", None, ["Cluster"]) == "household number"
    assert sv.label_of("HHID", None, ["Household number"]) == "hhid"
    names = sv.pick_columns(
        {"a": "Time to water source", "b": "Time to the water source", "c": "NA - time water source", "d": "Region"},
        {("time", "to", "water source"): "time"}, ["region"],
    )
    assert names == {"a": "time", "b": "time Time to the water source", "d": "region"}
    assert "cluster number" in sv.wanted_labels(["x"], ids=True, numbered=False)
    assert "x_Nr3" in sv.wanted_labels(["x"], ids=False)
    some = sv.wanted_labels(["x"], ids=False, known=["x", "x_Nr12", "x_Nr2", "y_Nr1", "x_Nr"])
    assert [c for c in some if c.startswith(("x", "y"))] == ["x", "x_Nr2", "x_Nr12"]


def test_known_column_falls_back(spark):
    df = spark.createDataFrame([(None, "a")], "x1 string, x2 string")
    labels = {"x1": "Source of drinking water", "x2": "source of drinking water, other"}
    assert sv.find_known_column(df, labels, "water") == "x2"
    assert sv.find_known_column(df.withColumn("HV201", F.lit(1)), labels, "water") == "HV201"
    assert sv.find_known_column(df, labels, "year") is None


def test_stage_is_built_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert fl.stage(spark, path, build).count() == 3 and fl.stage(spark, path, build).count() == 3 and len(calls) == 1
    fl.stage(spark, path, build, overwrite=True)
    assert len(calls) == 2


def test_written_keys_and_files(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.when(F.col("id") < 80, "hot").otherwise("cold"))
    fl.write_by(df, str(tmp_path / "out"), ["k"], files_per_key=3)
    files = sv.list_files(spark, str(tmp_path / "out"), "*.parquet")
    per = {r["folder"]: r["count"] for r in files.groupBy("folder").count().collect()}
    assert set(per) == {"k=hot", "k=cold"} and spark.read.parquet(str(tmp_path / "out")).count() == 100
    fl.write_flat(df, str(tmp_path / "flat"))
    assert fl.read_csv(spark, str(tmp_path / "flat.csv"), columns=["k"]).count() == 100


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(5).write.option("header", True).mode("append").csv(src)
    for _ in range(2):
        ingest_new_files(spark, src, "id bigint", out, state).awaitTermination()
    spark.range(5, 8).write.option("header", True).mode("append").csv(src)
    ingest_new_files(spark, src, "id bigint", out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))
    assert finished_files(spark, out).agg(F.sum("rows")).first()[0] == 8


def test_download_list_rules(spark):
    df = spark.createDataFrame([("KEN", 2010, "a"), ("KEN", 2014, "b.tif"), ("MOZ", 2018, "c")], "country string, DHSYEAR int, TIF_name string")
    assert {r["TIF_name"] for r in fl.download_list(df, min_year=2014).collect()} == {"b.tif", "c.tif"}
    got = fl.download_list(df, country="KEN", year=2020, limit=1).collect()
    assert [(r["TIF_name"], r["DHSYEAR"]) for r in got] == [("a_2020.tif", 2020)]


def test_missing_jdbc_driver_is_reported(spark):
    with pytest.raises(Exception):
        fl.read_catalogue(spark, "jdbc:none:none")


def test_ethiopian_survey_dates(spark):
    raw = spark.createDataFrame([(2000, 1, 1)], "HV007 int, HV006 int, HV016 int")
    labels = {"HV007": "year of interview", "HV006": "month of interview", "HV016": "day of interview"}
    r = sv.decode_survey(raw, "ETHR5A", labels, {}, ["year of interview"]).first()
    assert datetime.date(r["year of interview"], r["month of interview"], r["day of interview"]) == datetime.date(2007, 9, 12)
