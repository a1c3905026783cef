"""Reproducible pseudo-random order from md5, the same on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = float(16**12)


def seeded_hash(seed: int | str, *cols: Column | str) -> Column:
    """48-bit number from md5 of seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def seeded_unit(seed: int | str, *cols: Column | str) -> Column:
    """Uniform number in [0, 1)."""
    return seeded_hash(seed, *cols).cast("double") / F.lit(HASH_SPAN)
