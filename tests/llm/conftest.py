from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (id, text[, source]) as a documents table with an extra column whose name clashes with inner ones."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT).repartition(parts)
        for name in ("k1", "bucket", "h", "score", "slot", "rep", "v"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def hard_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    base = " ".join(f"word{i}" for i in range(300))
    return [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n "), (None, base), (None, None),
        (7, "one"), (8, "one"), (9, "a " * 5000), (10, "x" * 30000), (11, "Ünïcode wörds 漢字 " * 200), (12, "short text here"),
        (13, " ".join(f"long{i}" for i in range(8000))), (13, "another text of that id"),
    ]
