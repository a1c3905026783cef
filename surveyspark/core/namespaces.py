"""Grammar of feature-column names: ``"<dataset>; <question>: <statistic or category>"``."""

from __future__ import annotations

from dataclasses import dataclass

# The dataset prefixes of the feature table.
META = "Meta"
NUMERIC = "DHS Num"
CATEGORICAL = "DHS Cat"
FOOD_SECURITY = "FS"
ONE_HOT = "Meta one-hot encoding"
FREQUENCY = "Meta frequency encoding"
EDUCATION = "DHS Education"
SUSTAIN = "DHS Sustainbench"


@dataclass(frozen=True)
class Feature:
    dataset: str | None
    question: str
    stat: str | None


def parse(name: str) -> Feature:
    dataset, sep, rest = name.partition("; ")
    if not sep:
        dataset, rest = None, name
    question, sep, stat = rest.rpartition(": ")
    return Feature(dataset, question if sep else rest, stat if sep else None)


def build(dataset: str, question: str, stat: str | None = None) -> str:
    return f"{dataset}; {question}" + (f": {stat}" if stat is not None else "")


def quoted(name: str) -> str:
    """Column reference that survives dots and blanks in the name."""
    return "`" + name.replace("`", "``") + "`"
