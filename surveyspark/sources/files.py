"""CSV and Parquet tables, stages, routed outputs and work lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.core.namespaces import quoted as q

# Columns of the catalogue listing; the name of the contact column differs by database.
CATALOGUE_COLUMNS = ["Filename", "Title", "coverage district", "coverage province", "description"]
CONTACT_PREFIX = "Contact person"


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | None = None, columns: Sequence[str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with header; without a schema all columns are text. Unused columns are not parsed."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", False)
    df = reader.csv(path)
    return df.select(*[F.col(q(c)) for c in columns]) if columns else df


def read_csvs_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files of differing columns, united by column name."""
    out = None
    for p in paths:
        part = read_csv(spark, p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_file_id(df: DataFrame, pattern: str, out: str = "ID") -> DataFrame:
    """Id from the name of the file a row came from (first group of the pattern)."""
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """Stage table: read if finished before, else built and written first."""
    if overwrite or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_by(df: DataFrame, path: str, keys: Sequence[str], format: str = "parquet", files_per_key: int | None = None) -> None:
    """One folder per combination of keys.

    Rows of a key are brought together by key and a salt, so a hot key is written by several
    tasks; without ``files_per_key`` the adaptive plan splits and joins partitions by size.
    """
    if files_per_key:
        salt = F.pmod(F.xxhash64(*[F.col(q(c)) for c in df.columns]), F.lit(files_per_key))
        df = df.repartition(*[F.col(q(k)) for k in keys], salt)
    else:
        df = df.hint("rebalance", *[F.col(q(k)) for k in keys])
    writer = df.write.mode("overwrite").partitionBy(*keys)
    (writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path))


def write_flat(df: DataFrame, path: str) -> None:
    """The table as Parquet and as CSV."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def route_by_period(year: Column | str) -> Column:
    """Folder of a tile by survey year: before 2015, after 2015, 2015 itself."""
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y < 2015, "2012_2014").when(y > 2015, "2016_2020").when(y == 2015, "2015")


def route_tiles(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles with region type from their name and period from their label."""
    kind = F.when(F.col("Filename").endswith("u_2.0.tif"), "urban").when(F.col("Filename").endswith("r_10.0.tif"), "rural")
    return tiles.join(labels, "Filename").withColumns({"region": kind, "period": route_by_period("SURVEY_YEAR")})


def route_by_last_year(df: DataFrame, survey: str, year: str, limit: int = 2013) -> DataFrame:
    """Whole surveys routed to ``before`` if their last year lies before the limit, else ``kept``."""
    last = df.groupBy(survey).agg(F.max(year).alias("__last"))
    return df.join(last, survey).withColumn(
        "bucket", F.when(F.col("__last") < limit, f"before_{limit}").otherwise("kept")
    ).drop("__last")


def route_by_survey_name(files: DataFrame, surveys: DataFrame) -> DataFrame:
    """Tiles with the survey their name begins with (name up to the cluster digits)."""
    prefix = F.regexp_extract("name", r"^(.*?[A-Za-z])[0-9]*\.[^.]*$", 1)
    return files.withColumn("survey", prefix).join(surveys.select("survey").distinct(), "survey", "left_semi")


def open_work(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is not in the ledger of finished keys."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def append_ledger(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of every file of a task; a file's lines follow each other."""
    last = None
    for batch in batches:
        paths, lines = batch.column("path"), batch.column("line")
        at = []
        for i, path in enumerate(paths.to_pylist()):
            if path != last:
                at.append(i)
                last = path
        yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in (paths, lines)], names=["path", "header"])


def file_headers(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and first line of every file below a folder, read in tasks; empty files have none."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    first = lines.filter("_metadata.file_block_start = 0").select(plain.alias("path"), F.col("value").alias("line"))
    return first.mapInArrow(_first_lines, "path string, header string")


def sweep_summaries(spark: SparkSession, root: str, marker: str, min_amount: int = 100, amount: str = "test amount") -> dict[str, DataFrame]:
    """Run summaries below a folder, tagged with the folder two levels up: all, old and new ones.

    ``new`` lacks the marker column in its file, ``old`` has it; both only with more than
    ``min_amount`` test rows. Headers are read in tasks; the driver sees their paths, grouped
    by header, and makes one scan for each distinct header.
    """
    from surveyspark.core.bounded import collect_bounded

    found = file_headers(spark, root, "*run_summary*split_*.csv")
    found = found.filter(~F.contains(F.element_at(F.split("path", "/"), -1), F.lit("splits")))
    groups: dict[str, list[str]] = {}
    for r in sorted(collect_bounded(found, 1_000_000, "summary files"), key=lambda r: r["path"]):
        groups.setdefault(r["header"], []).append(r["path"])
    out: dict[str, DataFrame | None] = {"all": None, "old": None, "new": None}

    def add(name: str, df: DataFrame) -> None:
        out[name] = df if out[name] is None else out[name].unionByName(df, allowMissingColumns=True)

    for members in groups.values():
        df = read_csv(spark, members)
        header = df.columns
        df = df.withColumn("split name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
        df = df.withColumn("split name", F.url_decode("split name"))
        add("all", df)
        if amount in header:
            big = df.filter(F.col(q(amount)).try_cast("double") > min_amount)
            add("old" if marker in header else "new", big)
    return {k: v for k, v in out.items() if v is not None}


def attach_predictions(areas: DataFrame, predictions: DataFrame, area: str = "adm2_name", key: str = "adm2_gaul", file: str = "file") -> DataFrame:
    """Every area once per prediction file, with that file's prediction where there is one."""
    fresh = [c for c in predictions.columns if c not in areas.columns and c not in (key, file)]
    preds = predictions.select(F.col(q(key)).alias("__k"), F.col(q(file)).alias("__f"), *[F.col(q(c)) for c in fresh])
    names = predictions.agg(F.collect_set(file).alias("f")).scalar()
    spread = areas.withColumn("__files", names).withColumn(file, F.explode("__files")).drop("__files")
    out = spread.join(preds, (F.col(q(area)) == F.col("__k")) & (F.col(q(file)) == F.col("__f")), "left")
    return out.withColumn(key, F.col("__k")).drop("__k", "__f")


def download_list(
    df: DataFrame, done: DataFrame | None = None, country: str | None = None, year: int | None = None,
    min_year: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Tiles still to be fetched: grid ids get names, a target country and year override, finished ones go."""
    from surveyspark.operators.quality import zero_fill

    if "country" not in df.columns:
        name = F.concat(F.lit(f"{country}_GRID_{year}_"), zero_fill(F.col("id"), 8), F.lit(".tif"))
        df = df.withColumns({"country": F.lit(country), "DHSYEAR": F.lit(year), "TIF_name": name, "URBAN_RURA": F.lit(0)})
    elif country:
        df = df.filter(F.col("country") == country)
        if year:
            stem = F.regexp_replace("TIF_name", r"\.tif$", "")
            df = df.withColumns({"DHSYEAR": F.lit(year), "TIF_name": F.concat(stem, F.lit(f"_{year}.tif"))})
    elif min_year:
        df = df.filter(F.col("DHSYEAR") >= min_year)
    named = F.when(F.col("TIF_name").endswith(".tif"), F.col("TIF_name")).otherwise(F.concat("TIF_name", F.lit(".tif")))
    df = df.withColumn("TIF_name", named)
    if done is not None:
        df = open_work(df, done.withColumnRenamed(done.columns[0], "TIF_name"), "TIF_name")
    return df.orderBy("TIF_name").limit(limit) if limit else df


def read_catalogue(spark: SparkSession, url: str, table: str = "public.metadata", options: Mapping[str, str] | None = None) -> DataFrame:
    """Catalogue listing of a relational database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return catalogue_columns(reader.load())


def catalogue_columns(df: DataFrame) -> DataFrame:
    """File name, title, contact, coverage and description of every data set."""
    contact = [c for c in df.columns if c.startswith(CONTACT_PREFIX)]
    names = [*CATALOGUE_COLUMNS[:2], *contact, *CATALOGUE_COLUMNS[2:]]
    return df.select(*[F.col(q(c)) for c in names])


def route_points(points: DataFrame) -> DataFrame:
    """Locations with the table they belong to (survey clusters or service points) and their tile name."""
    spa = F.col("SPAID").isNotNull() if "SPAID" in points.columns else F.lit(False)
    ident = F.coalesce("SPAID", "DHSID") if "SPAID" in points.columns else F.col("DHSID")
    return points.withColumns(
        {
            "sink": F.when(spa, "locations_SPA").otherwise("locations"),
            "TIF_name": F.concat("GEID", F.right(ident, F.lit(8))),
        }
    )
