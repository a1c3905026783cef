"""Decisions on numbers that stand for answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.text import as_number, as_text_remainder


def numbers_as_keys(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether the numbers of a column are keys of its answers.

    ``values``: column, value. ``keys``: column, key (number), label. Result per column:
    distinct numbers found and not found among the keys, and the decision.
    """
    distinct = values.select("column", as_number("value").alias("x")).filter("x IS NOT NULL").distinct()
    known = keys.select(F.col("column").alias("__c"), F.col("key").alias("__k")).distinct()
    met = distinct.join(known, (F.col("column") == F.col("__c")) & (F.col("x") == F.col("__k")), "left")
    out = met.groupBy("column").agg(F.count("__k").alias("found"), (F.count(F.lit(1)) - F.count("__k")).alias("missing"))
    return out.withColumn(
        "decision",
        F.when((F.col("missing") == 0) & (F.col("found") > 0), "True")
        .when((F.col("missing").between(1, 2)) & (F.col("found") > 0), "Maybe")
        .otherwise("False"),
    )


def key_mapping(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Mapping rows (column, from, to) for the numbers that are keys."""
    distinct = values.select("column", F.col("value").alias("from"), as_number("value").alias("x")).filter("x IS NOT NULL").distinct()
    k = keys.select(F.col("column").alias("__c"), F.col("key").alias("__k"), F.col("label").alias("to"))
    return distinct.join(k, (F.col("column") == F.col("__c")) & (F.col("x") == F.col("__k"))).select("column", "from", "to")


def yes_no_mapping(values: DataFrame, max_numbers: int = 150) -> DataFrame:
    """Mapping that makes a column of mixed yes / no and 1 / 0 uniform: column, from, to.

    Only for columns with 0, 1, yes and less than ``max_numbers`` distinct numbers; the
    texts become numbers when a 2 occurs or numbers are more frequent, else the reverse.
    """
    x, s = as_number("value"), as_text_remainder("value")
    flags = values.groupBy("column").agg(
        F.max((x == 0).cast("int")).alias("zero"), F.max((x == 1).cast("int")).alias("one"), F.max((x == 2).cast("int")).alias("two"),
        F.count(x).alias("numbers"), F.count(s).alias("texts"), F.max(s.endswith("yes").cast("int")).alias("yes"),
    )
    distinct = values.select("column", x.alias("x")).filter("x IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("kinds"))
    use = flags.join(distinct, "column").filter(F.col("kinds") < max_numbers).filter("zero = 1 AND one = 1 AND yes = 1")
    use = use.select("column", ((F.coalesce("two", F.lit(0)) == 1) | (F.col("numbers") > F.col("texts"))).alias("to_number"))
    answers = values.filter(F.col("value").isNotNull()).select("column", "value").distinct().join(use, "column")
    v, n = F.col("value"), as_number("value")
    to = F.when(F.col("to_number"), F.when(v.endswith("yes"), "1").when(v.endswith("no"), "0")).otherwise(
        F.when(n == 1, "yes").when(n == 0, "no")
    )
    return answers.select("column", v.alias("from"), to.alias("to")).filter("`to` IS NOT NULL")
