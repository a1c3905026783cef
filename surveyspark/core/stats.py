"""Statistics that give null instead of failing where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation of the rows where both are known; null without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])
