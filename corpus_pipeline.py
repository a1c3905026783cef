"""From raw documents to packed training sequences, five stages of the llm subpackage.

Each stage works on all its predecessor kept, written as Parquet and read again. No SQL says
a trained classifier, a trained tagger or token ids, so there is none for the whole run.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.core.session import cut_lineage, ensure_checkpoint_dir
from surveyspark.llm.forest_dedup import near_components
from surveyspark.llm.mixing import mixed
from surveyspark.llm.packing import pack
from surveyspark.llm.pii import fit_tagger, redact
from surveyspark.llm.toxicity import fit_toxicity, held_out

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; ids of the held-out third teach nothing."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = fit_toxicity(docs, labels.filter(~held_out("doc_id")))
    return docs.filter(model.score("text") < TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null ids stay; of rows that repeat a kept id, the one with the smallest text does.
    """
    components = cut_lineage(near_components(docs, words=5))
    dropped = components.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = cut_lineage(components.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    first = F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("doc_id", "row.*")
    return left.join(repeated, "doc_id", "left_anti").unionByName(one).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = redact(docs, fit_tagger(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the source mixture."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; tables between them lie in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = os.path.join(folder, f"{i}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
