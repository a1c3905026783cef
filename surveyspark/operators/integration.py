"""Uniting columns that ask the same question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.core.namespaces import quoted as q
from surveyspark.functions.text import as_number
from surveyspark.operators.aggregates import integration_decision
from surveyspark.operators.quality import known_counts

# Below this similarity of names columns are not compared, above this share of
# known answers a base column is skipped, below this sum of shares a group is not looked at.
MIN_NAME_SIMILARITY, FULL_COLUMN, MIN_GROUP_PERCENT = 79.0, 99.9, 10.0

RESULT = (
    "base string, column string, round int, name_similarity double, overwriting double, different double, "
    "integrated_overwriting double, integrated_different double, decision string"
)


def integrate_columns(
    df: DataFrame, columns: Sequence[str], name_similarity: Mapping[tuple[str, str], float],
    answer_similarity: Mapping[tuple[str, str], float] | None = None, min_percent: float = MIN_GROUP_PERCENT,
) -> DataFrame:
    """Compare the columns of a group with its most complete one; the undecided rest goes on to a next round.

    In every round the base column is met by the others in order of completeness. A column
    that never differs from the base is filled into it, and later ones are also compared
    with the filled base. One aggregation per compared column; the loop runs over columns.
    """
    rows, known = known_counts(df, columns)
    answer_similarity = answer_similarity or {}
    group = sorted(columns, key=lambda c: (-known[c], list(columns).index(c)))
    out = None
    nr = 0

    def similar(table: Mapping[tuple[str, str], float], a: str, b: str) -> float | None:
        return table.get((a, b), table.get((b, a)))

    while len(group) >= 2 and rows and sum(known[c] for c in group) / rows * 100 >= min_percent:
        nr += 1
        base, rest = group[0], []
        if known[base] / rows * 100 >= FULL_COLUMN:
            group = group[1:]
            continue
        filled, first = F.col(q(base)), True
        for c in group[1:]:
            rest.append(c)
            sim = similar(name_similarity, base, c)
            if sim is not None and sim < MIN_NAME_SIMILARITY:
                part = df.sparkSession.createDataFrame(
                    [(base, c, nr, sim, None, None, None, None, f"False: cosine similarity of column names to low {sim}")], RESULT
                )
                out = part if out is None else out.unionByName(part)
                continue
            cols = [F.col(q(base)).alias("b"), F.col(q(c)).alias("o"), filled.alias("f")]
            agg = df.select(*cols).agg(
                *[
                    F.round(F.count(F.when(cond, 1)) / F.nullif(F.count("o"), F.lit(0)) * 100, 2).alias(n)
                    for n, cond in (
                        ("overwriting", F.col("b").isNotNull() & F.col("o").isNotNull()),
                        ("different", F.col("b") != F.col("o")),
                        ("integrated_overwriting", F.col("f").isNotNull() & F.col("o").isNotNull()),
                        ("integrated_different", F.col("f") != F.col("o")),
                    )
                ],
                *[F.avg(as_number(x)).alias(f"m_{x}") for x in ("b", "o")],
                F.stddev_samp(as_number("o")).alias("s_o"),
            )
            gap = F.abs(F.col("m_b") - F.col("m_o"))
            numbers = F.when(gap < F.col("s_o"), "True").when(gap < 2 * F.col("s_o"), "Maybe ").when(gap.isNotNull(), "False ")
            types = F.when(F.col("m_b").isNull() == F.col("m_o").isNull(), "True").otherwise("False")
            ans = similar(answer_similarity, base, c)
            decision = integration_decision(
                {
                    "different": F.col("different"), "overwriting": F.col("overwriting"),
                    "name_similarity": F.lit(100.0 if sim is None else float(sim)),
                    "answer_similarity": F.lit(ans).cast("double"),
                    "type_similarity": types, "number_similarity": numbers,
                    "integrated_overwriting": F.col("integrated_overwriting") if not first else F.lit(None).cast("double"),
                    "integrated_different": F.col("integrated_different") if not first else F.lit(None).cast("double"),
                }
            )
            part = agg.select(
                F.lit(base).alias("base"), F.lit(c).alias("column"), F.lit(nr).alias("round"),
                F.lit(sim).cast("double").alias("name_similarity"), "overwriting", "different",
                "integrated_overwriting", "integrated_different", decision.alias("decision"),
            )
            row = part.first()
            done = df.sparkSession.createDataFrame([tuple(row)], RESULT)
            out = done if out is None else out.unionByName(done)
            if not row["different"]:
                filled, first = F.coalesce(filled, F.col(q(c))), False
        group = rest
    return out
