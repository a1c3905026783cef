"""Scaling of columns and its inverse, with the parameters kept beside the data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def min_max(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    s = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    span = F.when(s["hi"] > s["lo"], s["hi"] - s["lo"]).otherwise(F.lit(1.0))
    return df.withColumn(out or col, (F.col(col) - s["lo"]) / span)


def z_score(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Standardised with the population deviation."""
    s = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).alias("s")).scalar()
    dev = F.when(s["s"] > 0, s["s"]).otherwise(F.lit(1.0))
    return df.withColumn(out or col, (F.col(col) - s["m"]) / dev)


def flip_sign(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, -F.col(col))


@dataclass(frozen=True)
class Scaling:
    """Parameters of a label transformation, in the order shift, Box-Cox, offset and scale."""

    shift: float = 0.0
    power: float | None = None
    offset: float = 0.0
    scale: float = 1.0

    def apply(self, c: Column) -> Column:
        y = c + self.shift
        if self.power is not None:
            y = F.log(y) if abs(self.power) < 1e-12 else (F.pow(y, F.lit(self.power)) - 1) / self.power
        return (y - self.offset) / self.scale

    def invert(self, c: Column) -> Column:
        y = c * self.scale + self.offset
        if self.power is not None:
            y = F.exp(y) if abs(self.power) < 1e-12 else F.pow(y * self.power + 1, F.lit(1 / self.power))
        return y - self.shift


def box_cox_power(df: DataFrame, col: Column, low: float = -5.0, high: float = 5.0, rounds: int = 4, points: int = 41) -> float:
    """Power with the highest Box-Cox log-likelihood.

    Every round scores a whole grid of powers in one aggregation and zooms in around the
    best one, so the data is read ``rounds`` times whatever the precision.
    """
    y = F.log(col)
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        aggs = [F.count(col).alias("n"), F.avg(y).alias("ml")]
        for i, lam in enumerate(grid):
            t = y if abs(lam) < 1e-12 else (F.pow(col, F.lit(lam)) - 1) / lam
            aggs.append(F.var_pop(t).alias(f"v{i}"))
        r = df.agg(*aggs).first()

        def score(i: int) -> float:
            v = r[f"v{i}"]
            if v is None or v <= 0 or math.isnan(v) or math.isinf(v):
                return -math.inf
            return (grid[i] - 1) * r["ml"] * r["n"] - r["n"] / 2 * math.log(v)

        best = max(range(points), key=score)
        step = (high - low) / (points - 1)
        low, high = grid[best] - step, grid[best] + step
    return grid[best]


def fit_scaling(df: DataFrame, col: str, transform: str | None = None, normalise: str | None = None) -> Scaling:
    """Parameters for Box-Cox (values shifted above zero first) and for ``Z`` or ``0,1`` scaling."""
    c = F.col(col).cast("double")
    shift, power = 0.0, None
    if transform == "boxcox":
        lowest = df.agg(F.min(c).alias("m")).first()["m"]
        shift = abs(lowest) + 1 if lowest <= 0 else 0.0
        power = box_cox_power(df, c + shift)
    elif transform:
        raise ValueError(f"unknown transformation {transform}")
    s = Scaling(shift, power)
    if normalise is None:
        return s
    t = s.apply(c)
    r = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.avg(t).alias("m"), F.stddev_pop(t).alias("sd")).first()
    if normalise == "Z":
        return Scaling(shift, power, r["m"], r["sd"] or 1.0)
    if normalise == "0,1":
        return Scaling(shift, power, r["lo"], (r["hi"] - r["lo"]) or 1.0)
    raise ValueError(f"unknown normalisation {normalise}")
