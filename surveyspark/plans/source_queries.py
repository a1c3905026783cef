"""Discovery, decoding, stages, routing, work lists and incremental ingest.

Queries that need files write what they derive from the tables below the shared checkpoint
folder and read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from surveyspark.core.session import ensure_checkpoint_dir
from surveyspark.plans.registry import Tables, query, r, rounded
from surveyspark.plans.views import SOURCES, oracle_views
from surveyspark.sources import files as fl
from surveyspark.sources import surveys as sv


def _scratch(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "survey_files",
    ["SC-1", "PF-18"],
    f"""{oracle_views('households')}, s AS (SELECT DISTINCT survey AS folder FROM households)
        SELECT folder, substr(folder, 1, 2) AS country, CAST(substr(folder, 5, 1) AS INT) AS version FROM s
        WHERE CAST(substr(folder, 5, 1) AS INT) BETWEEN 3 AND 6 AND substr(folder, 1, 2) NOT IN ('AA', 'BB')""",
)
def survey_files(t: Tables):
    folders = t.households.select(F.col("survey").alias("folder")).distinct()
    return sv.find_surveys(folders, "HR", 3, 6, ["AA", "BB"]).select("folder", "country", "version")


@query(
    "listed_files", ["SC-2"],
    " UNION ALL ".join(f"SELECT '{n}.parquet' AS name, count(*) AS rows FROM {n}" for n in SOURCES),
)
def listed_files(t: Tables):
    """Files of the folder with the rows they hold."""
    files = sv.list_files(t.spark, t.dir, "*.parquet").select("name")
    return files.join(sv.rows_per_file(t.spark, t.dir), "name", "left").select("name", F.coalesce("rows", F.lit(0)).alias("rows"))


def _raw(t: Tables):
    """The orders as one raw survey with column codes."""
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("HV001"), k.alias("HV002"), F.concat(F.lit("AO"), F.lit("5")).alias("HV000"),
        (k % 5).cast("double").alias("HV201"), F.lit("").alias("HV024"), F.col("o_orderstatus").alias("HV026"),
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, " "), F.lpad(k.cast("string"), 8, " ")).alias("HHID"),
        F.year("o_orderdate").alias("HV007"), F.month("o_orderdate").alias("HV006"), F.dayofmonth("o_orderdate").alias("HV016"),
    )


_LABELS = {
    "HV001": "Cluster number", "HV002": "Household number", "HV000": "Country code and phase", "HV201": "Source of drinking water",
    "HV024": "Region", "HV026": "Status", "HHID": "Case Identification", "HV007": "Year of interview", "HV006": "Month of interview",
    "HV016": "Day of interview",
}
_ANSWERS = {"HV201": {0.0: "Piped", 1.0: "Well", 2.0: "Spring", 3.0: "Rain"}}
_WATER = "CASE o_orderkey % 5 WHEN 0 THEN '0: piped' WHEN 1 THEN '1: well' WHEN 2 THEN '2: spring' WHEN 3 THEN '3: rain' ELSE '4.0' END"


@query(
    "decoded_survey",
    ["SC-3", "PF-15", "PF-18"],
    f"""SELECT {_WATER} AS "source of drinking water", CAST(NULL AS VARCHAR) AS region, 'AOHR5A' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS "DHSID",
          'AOHR5A' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS "DHSID + HHID",
          'AOGE5AFL' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS "GEID", 5 AS version_nr, 'A' AS subversion_nr FROM orders""",
)
def decoded_survey(t: Tables):
    labels = {c: sv.label_of(c, n, list(_LABELS.values())) for c, n in _LABELS.items()}
    out = sv.decode_survey(
        _raw(t), "AOHR5A", labels, _ANSWERS, ["source of drinking water", "region"], make_ids=True, make_version=True, locations="AOGE5AFL"
    )
    return out.select("source of drinking water", "region", "DHSID", "DHSID + HHID", "GEID", "version_nr", "subversion_nr")


@query(
    "loaded_surveys",
    ["SC-5", "SO-1", "SC-3"],
    f"""SELECT 'AOHR5' || o_orderstatus AS survey, CASE o_orderkey % 5 WHEN 0 THEN 'piped' WHEN 1 THEN 'well' WHEN 2 THEN 'spring' WHEN 3 THEN 'rain' ELSE '4.0' END AS "source of drinking water",
          CAST(o_custkey AS VARCHAR) AS "cluster number" FROM orders""",
)
def loaded_surveys(t: Tables):
    rows = [(f"AOHR5{s}", c, n) for s in "FOP" for c, n in _LABELS.items()]
    columns = t.spark.createDataFrame(rows, "survey string, code string, label string")
    values = t.spark.createDataFrame(
        [(f"AOHR5{s}", "HV201", k, v) for s in "FOP" for k, v in _ANSWERS["HV201"].items()], "survey string, code string, key double, label string"
    )
    raw = _raw(t)
    out = sv.load_surveys(
        [f"AOHR5{s}" for s in "FOP"], lambda s: raw.filter(F.col("HV026") == s[-1]), columns, values,
        labels=["source of drinking water", "cluster number"], with_keys=False,
    )
    return out.select("survey", "source of drinking water", "cluster number")


@query(
    "ethiopian_survey",
    ["SC-3", "SF-22"],
    """WITH e AS (SELECT o_orderkey, DATE '1970-01-01' + CAST(1723856 + 365 * year(o_orderdate) + year(o_orderdate) // 4 + 30 * month(o_orderdate) + day(o_orderdate) - 31 - 2440588 AS INTEGER) AS d FROM orders)
       SELECT year(d) AS "year of interview", month(d) AS "month of interview", day(d) AS "day of interview", count(*) AS n FROM e GROUP BY ALL""",
)
def ethiopian_survey(t: Tables):
    labels = {c: n.lower() for c, n in _LABELS.items()}
    out = sv.decode_survey(_raw(t), "ETHR5A", labels, {}, ["year of interview"])
    return out.groupBy("year of interview", "month of interview", "day of interview").agg(F.count(F.lit(1)).alias("n"))


@query(
    "picked_columns",
    ["SC-6"],
    """SELECT l_orderkey AS "order key", l_extendedprice AS price, l_tax AS tax FROM lineitem""",
)
def picked_columns(t: Tables):
    labels = {"l_orderkey": "Order key", "l_extendedprice": "Extended price of line", "l_tax": "Tax", "l_shipdate": "NA - date", "l_quantity": "Quantity"}
    names = sv.pick_columns(labels, {("price", "line"): "price"}, ["order key", "tax"])
    return t.lineitem.select(*[F.col(c).alias(n) for c, n in names.items()])


@query("known_columns", ["SC-7"], "SELECT o_orderstatus AS water, count(*) AS n FROM orders GROUP BY ALL")
def known_columns(t: Tables):
    raw = t.orders.select(F.lit(None).cast("string").alias("c1"), F.col("o_orderstatus").alias("c2"), F.col("o_orderkey").alias("HV001"))
    labels = {"c1": "Source of drinking water", "c2": "Source of drinking water (2)", "HV001": "Cluster number"}
    col = sv.find_known_column(raw, labels, "water")
    assert sv.find_known_column(raw, labels, "cluster") == "HV001"
    return raw.groupBy(F.col(col).alias("water")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_tables_united",
    ["SC-8", "SC-9", "SC-16", "SC-17"],
    f"""{oracle_views('clusters')} SELECT cluster, {r('Actual', 8)} AS "Actual", DHSYEAR AS "DHSYEAR", adm0_name FROM clusters""",
)
def csv_tables_united(t: Tables):
    path = _scratch(t, "wealth")
    fl.write_by(t.clusters.select("cluster", "Actual", "DHSYEAR", "adm0_name"), path, ["DHSYEAR", "adm0_name"], "csv")
    back = fl.read_csv(t.spark, path, "cluster bigint, Actual double, DHSYEAR int, adm0_name string")
    return rounded(back, 8)


@query(
    "rows_with_file_id",
    ["SC-10"],
    f"{oracle_views('clusters')} SELECT cluster, adm0_name FROM clusters",
)
def rows_with_file_id(t: Tables):
    """The folder of each file tells the region; the id is parsed from its path."""
    path = _scratch(t, "byfile")
    fl.write_by(t.clusters.select("cluster", F.col("adm0_name").alias("part")), path, ["part"], "csv")
    raw = t.spark.read.option("header", True).option("recursiveFileLookup", True).schema("cluster bigint").csv(path)
    return raw.select("cluster", F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"part=([^/]+)/", 1).alias("adm0_name"))


@query(
    "catalogue_listing",
    ["SC-11"],
    """SELECT CAST(doc_id AS VARCHAR) AS "Filename", lang AS "Title", source AS "Contact person Email", lang AS "coverage district", source AS "coverage province", text AS description FROM documents""",
)
def catalogue_listing(t: Tables):
    d = t.documents
    rows = d.select(
        "n_chars", F.col("doc_id").cast("string").alias("Filename"), F.col("lang").alias("Title"), F.col("source").alias("Contact person Email"),
        F.col("lang").alias("coverage district"), F.col("source").alias("coverage province"), F.col("text").alias("description"),
    )
    return fl.catalogue_columns(rows)


@query(
    "routed_points",
    ["SC-12"],
    f"""{oracle_views('clusters')} SELECT cluster, CASE WHEN cluster % 6 = 0 THEN 'locations_SPA' ELSE 'locations' END AS sink, cc || 'GE5A' || lpad(CAST(cluster AS VARCHAR), 8, '0') AS "TIF_name" FROM clusters""",
)
def routed_points(t: Tables):
    ident = F.concat("cc", F.lit("2015"), F.lpad(F.col("cluster").cast("string"), 8, "0"))
    rows = t.clusters.select(
        "cluster", F.concat("cc", F.lit("GE5A")).alias("GEID"), F.when(F.col("cluster") % 6 != 0, ident).alias("DHSID"), F.when(F.col("cluster") % 6 == 0, ident).alias("SPAID")
    )
    return fl.route_points(rows).select("cluster", "sink", "TIF_name")


@query(
    "availability_matrix",
    ["SC-14"],
    f"""{oracle_views('households')}, s AS (SELECT DISTINCT substr(survey, 1, 2) AS country, substr(survey, 5, 2) AS version, CAST(substr(survey, 5, 1) AS INT) AS v FROM households)
        SELECT country, version, TRUE AS "HR", v > 4 AS "GE", FALSE AS "IR" FROM s""",
)
def availability_matrix(t: Tables):
    hr = t.households.select("survey").distinct()
    ge = hr.filter(F.substring("survey", 5, 1) > "4").select(F.concat(F.substring("survey", 1, 2), F.lit("GE"), F.expr("substring(survey, 5)")).alias("survey"))
    return sv.availability_matrix(hr.unionByName(ge), ["HR", "GE", "IR"])


@query("staged_table", ["SC-15", "SC-16"], f"{oracle_views('households')} SELECT household, source FROM households")
def staged_table(t: Tables):
    path = _scratch(t, "stage")
    fl.stage(t.spark, path, lambda: t.households.select("household", "source"))
    return fl.stage(t.spark, path, lambda: t.households.limit(0))


@query(
    "routed_surveys",
    ["SC-18"],
    f"""{oracle_views('households')}, l AS (SELECT cluster, max(year) AS y FROM households GROUP BY cluster)
        SELECT household, CASE WHEN y < 2001 THEN 'before_2001' ELSE 'kept' END AS bucket FROM households JOIN l USING (cluster)""",
)
def routed_surveys(t: Tables):
    return fl.route_by_last_year(t.households.select("household", "cluster", "year"), "cluster", "year", 2001).select("household", "bucket")


@query(
    "routed_tiles",
    ["SC-18"],
    f"""{oracle_views('clusters')} SELECT cluster, CASE WHEN URBAN_RURA = 'U' THEN 'urban' ELSE 'rural' END AS region,
        CASE WHEN DHSYEAR < 2015 THEN '2012_2014' WHEN DHSYEAR > 2015 THEN '2016_2020' ELSE '2015' END AS period FROM clusters""",
)
def routed_tiles(t: Tables):
    tail = F.when(F.col("URBAN_RURA") == "U", "_u_2.0.tif").otherwise("_r_10.0.tif")
    tiles = t.clusters.select("cluster", F.concat(F.col("cluster").cast("string"), tail).alias("Filename"))
    labels = t.clusters.select(F.concat(F.col("cluster").cast("string"), tail).alias("Filename"), F.col("DHSYEAR").alias("SURVEY_YEAR"))
    return fl.route_tiles(tiles, labels).select("cluster", "region", "period")


@query(
    "open_work",
    ["SC-19", "JN-6"],
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def open_work(t: Tables):
    path = _scratch(t, "ledger")
    fl.append_ledger(t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), path)
    return fl.open_work(t.customer.select("c_custkey"), t.spark.read.parquet(path), "c_custkey")


@query(
    "swept_summaries",
    ["SC-20"],
    f"""SELECT 'new' AS kind, 'run' || n_regionkey AS "split name", count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey < 3 AND c_custkey > 100 GROUP BY ALL
        UNION ALL SELECT 'old', 'run' || n_regionkey, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey >= 3 AND c_custkey > 100 GROUP BY ALL""",
)
def swept_summaries(t: Tables):
    root = _scratch(t, "runs")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_regionkey", F.col("c_custkey").alias("test amount"), F.col("c_acctbal").alias("rmse")
    )
    for i in range(5):
        part = rows.filter(F.col("n_regionkey") == i).drop("n_regionkey")
        if i >= 3:
            part = part.withColumn("mean(Std test Prediction)", F.lit(1.0))
        folder = f"{root}/run{i}/split_{i}"
        part.coalesce(1).write.option("header", True).csv(f"{folder}.tmp")
        _name_summary(t, f"{folder}.tmp", f"{folder}/run_summary_split_{i}.csv")
    found = fl.sweep_summaries(t.spark, root, "mean(Std test Prediction)")
    parts = [found[k].groupBy(F.lit(k).alias("kind"), "split name").agg(F.count(F.lit(1)).alias("n")) for k in ("new", "old")]
    return parts[0].unionByName(parts[1])


def _name_summary(t: Tables, folder: str, target: str) -> None:
    """Give a written part file the name run summaries have."""
    jvm = t.spark._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    fs.mkdirs(p(target).getParent())
    for s in fs.globStatus(p(f"{folder}/part-*.csv")):
        fs.rename(s.getPath(), p(target))


@query(
    "areas_with_predictions",
    ["SC-21"],
    f"""{oracle_views('clusters')}, p AS (SELECT adm0_name AS file, adm2_name AS adm2_gaul, avg(Prediction) AS p FROM clusters GROUP BY ALL),
        a AS (SELECT DISTINCT adm2_name FROM clusters), f AS (SELECT DISTINCT file FROM p)
        SELECT adm2_name, f.file, {r('p.p', 8)} AS prediction FROM a, f LEFT JOIN p ON p.file = f.file AND p.adm2_gaul = a.adm2_name""",
)
def areas_with_predictions(t: Tables):
    preds = t.clusters.groupBy(F.col("adm0_name").alias("file"), F.col("adm2_name").alias("adm2_gaul")).agg(F.avg("Prediction").alias("prediction"))
    out = fl.attach_predictions(t.clusters.select("adm2_name").distinct(), preds)
    return rounded(out.select("adm2_name", "file", "prediction"), 8)


@query(
    "download_list",
    ["SC-22", "SC-19"],
    f"""{oracle_views('clusters')} SELECT 'T' || cluster || '_2020.tif' AS "TIF_name", 2020 AS "DHSYEAR" FROM clusters WHERE adm0_name = 'ASIA' AND cluster % 3 <> 0""",
)
def download_list(t: Tables):
    rows = t.clusters.select(F.col("adm0_name").alias("country"), "DHSYEAR", F.concat(F.lit("T"), F.col("cluster").cast("string"), F.lit(".tif")).alias("TIF_name"))
    done = t.clusters.filter("cluster % 3 = 0").select(F.concat(F.lit("T"), F.col("cluster").cast("string"), F.lit("_2020.tif")).alias("f"))
    return fl.download_list(rows, done, "ASIA", 2020).select("TIF_name", "DHSYEAR")


@query(
    "grid_download_list",
    ["SC-22"],
    """SELECT 'MOZ_GRID_2022_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.tif' AS "TIF_name", 2022 AS "DHSYEAR" FROM part""",
)
def grid_download_list(t: Tables):
    return fl.download_list(t.part.select(F.col("p_partkey").alias("id")), country="MOZ", year=2022).select("TIF_name", "DHSYEAR")


@query(
    "household_numbers_from_case",
    ["PF-17"],
    """SELECT o_orderkey, o_custkey AS cluster, o_orderkey AS household FROM orders""",
)
def household_numbers_from_case(t: Tables):
    case = F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 9, " "))
    cluster, household = sv.numbers_from_case(case, F.col("o_custkey"))
    return t.orders.select("o_orderkey", cluster.alias("cluster"), household.alias("household"))


@query(
    "renumbered_households",
    ["PF-17", "PF-2"],
    """SELECT o_custkey AS "cluster number", o_orderkey AS "household number", TRUE AS "generated hhnr from case id" FROM orders""",
)
def renumbered_households(t: Tables):
    rows = t.orders.select(
        F.lit("AOHR5A").alias("survey"), F.col("o_custkey").cast("string").alias("cluster number"), F.lit("1").alias("household number"),
        F.concat(F.col("o_custkey").cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 9, " ")).alias("case identification"),
    )
    return sv.renumber_households(rows).select("cluster number", "household number", "generated hhnr from case id")


@query(
    "location_counterparts",
    ["PF-19"],
    f"""{oracle_views('households')}, s AS (SELECT DISTINCT survey FROM households)
        SELECT survey, CASE WHEN substr(survey, 5, 1) IN ('2', '4', '6', '8') THEN substr(survey, 1, 2) || 'GE' || substr(survey, 5, 1) ||
          CASE substr(survey, 6, 1) WHEN 'M' THEN 'K' ELSE 'B' END || 'FL' END AS location FROM s""",
)
def location_counterparts(t: Tables):
    surveys = t.households.select("survey").distinct()
    even = surveys.filter(F.substring("survey", 5, 1).isin("2", "4", "6", "8"))
    letter = F.when(F.substring("survey", 6, 1) == "M", "K").otherwise("B")
    locs = even.select(F.concat(F.substring("survey", 1, 2), F.lit("GE"), F.substring("survey", 5, 1), letter, F.lit("FL")).alias("location")).distinct()
    return sv.location_counterparts(surveys, locs)


@query(
    "ingested_files",
    ["ST-1"],
    f"{oracle_views('clusters')} SELECT cluster, upper(adm2_name) AS adm2_name FROM clusters",
)
def ingested_files(t: Tables):
    """Files that arrive in two goes are each taken in once."""
    from surveyspark.streaming.ingest import ingest_new_files

    root = _scratch(t, "ingest")
    rows = t.clusters.select("cluster", "adm2_name")
    schema = "cluster bigint, adm2_name string"

    def take() -> None:
        ingest_new_files(
            t.spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", lambda b: b.withColumn("adm2_name", F.upper("adm2_name"))
        ).awaitTermination()

    rows.filter("cluster % 2 = 0").write.option("header", True).mode("append").csv(f"{root}/in")
    take()
    rows.filter("cluster % 2 = 1").write.option("header", True).mode("append").csv(f"{root}/in")
    take()
    take()
    return t.spark.read.parquet(f"{root}/out").select("cluster", "adm2_name")
