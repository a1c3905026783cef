"""Newly arrived survey files taken in once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    decode: Callable[[DataFrame], DataFrame] | None = None,
    format: str = "csv",
    max_files: int = 1000,
) -> StreamingQuery:
    """Read files not seen before, decode them and write them below ``target``.

    The checkpoint remembers files; each batch replaces its own folder, so a batch that is
    run again after a failure leaves nothing twice. The query ends when all files are in.
    """
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", max_files)
    if format == "csv":
        reader = reader.option("header", True)
    incoming = reader.load(source).withColumn("source_file", F.col("_metadata.file_name"))

    def write(batch: DataFrame, batch_id: int) -> None:
        out = decode(batch) if decode else batch
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def finished_files(spark: SparkSession, target: str) -> DataFrame:
    """Ledger: files taken in, their batch and rows."""
    return spark.read.parquet(target).groupBy("source_file", "batch").agg(F.count(F.lit(1)).alias("rows"))
