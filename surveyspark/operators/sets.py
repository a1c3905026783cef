"""Unions, set comparisons of columns, subsets and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.core.hashing import seeded_hash
from surveyspark.functions.text import null_tokens


def outer_union(frames: Sequence[DataFrame], clean: bool = True) -> DataFrame:
    """Union by column name; columns missing in a frame are null. Text columns lose their null tokens."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if clean:
        texts = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
        out = out.withColumns({c: null_tokens(F.col(f"`{c}`")) for c in texts})
    return out


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, f in frames.items():
        part = f.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def common_columns(column_labels: DataFrame, by: str = "label") -> DataFrame:
    """Per label (or code): surveys that have it, whether all have it, and the codes (labels) it goes with."""
    other = "code" if by == "label" else "label"
    surveys = column_labels.agg(F.countDistinct("survey").alias("n")).scalar()
    return (
        column_labels.select(F.lower(by).alias(by) if by == "label" else F.col(by), "survey", other)
        .groupBy(by)
        .agg(F.countDistinct("survey").alias("surveys"), F.array_sort(F.collect_set(other)).alias(f"{other}s"))
        .withColumn("common", F.col("surveys") == surveys)
    )


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key along an order; an aggregation, so copies are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def powerset(df: DataFrame, item: str, limit: int = 20) -> DataFrame:
    """All subsets of a small list of options: one row per subset with its size, in order of size."""
    from surveyspark.core.bounded import collect_bounded

    items = sorted(r[0] for r in collect_bounded(df.select(item).distinct(), limit, "options of a power set"))
    n = len(items)
    arr = F.array(*[F.lit(i) for i in items])
    masks = df.sparkSession.range(2**n)
    picked = F.filter(arr, lambda x, i: F.col("id").bitwiseAND(F.pow(F.lit(2.0), i).cast("bigint")) != 0)
    return masks.select(picked.alias("subset")).withColumn("size", F.size("subset"))


def shuffled(df: DataFrame, ident: Sequence[str], seed: int) -> DataFrame:
    """Reproducible random order."""
    return df.orderBy(seeded_hash(seed, *ident))


def sample_rows(df: DataFrame, ident: Sequence[str], n: int, seed: int) -> DataFrame:
    """Reproducible random sample of ``n`` rows."""
    return df.orderBy(seeded_hash(seed, *ident)).limit(n)


def top_pairs(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Most frequent combinations; ties in order of the values."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols).limit(n)


def reorder_columns(df: DataFrame, first: Sequence[str], after: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Columns for review tables: ``first`` in front, others by name, some directly after a given column."""
    after = after or {}
    moved = {c for cs in after.values() for c in cs}
    rest = sorted(c for c in df.columns if c not in first and c not in moved)
    names: list[str] = []
    for c in [*first, *rest]:
        if c in df.columns:
            names.append(c)
            names += [m for m in after.get(c, []) if m in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in names])
