"""Registered queries over the driver tables, each with an SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}


def query(name: str, ids: Sequence[str], oracle: str | None = None):
    """Register a query under ``name`` for the operators ``ids``."""

    def add(fn: Callable[["Tables"], DataFrame]) -> Callable[["Tables"], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        OPERATORS[name] = list(ids)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


class Tables:
    """Driver tables and the survey-like views derived from them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        from surveyspark.plans.views import SOURCES, VIEWS

        if name in SOURCES:
            return self.table(name)
        if name in VIEWS:
            sql, parts = VIEWS[name]
            return self.spark.sql(sql, **{p: getattr(self, p) for p in parts})
        raise AttributeError(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, with negative zero made zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float"):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in oracle SQL."""
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"
