"""Driver-side access to tables that are small by nature, with the size checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def collect_bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a table of at most ``limit`` rows; more rows raise instead of being cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, refusing to bring them to the driver")
    return rows
