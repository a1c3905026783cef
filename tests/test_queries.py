"""Every registered query against its oracle on the smallest driver tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from surveyspark.plans.registry import OPERATORS  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

#: Queries that SQL can't express (seeded packing, models, iterative imputers, word similarity); fixtures test these.
WITHOUT_ORACLE = {
    "answer_word_similarity", "water_indices", "wealth_clusters", "packed_split_sizes", "packed_split", "year_disjoint_split",
    "mean_balanced_split", "mean_balanced_year_split", "kmeans_labels", "unified_answers",
    "unified_answer_shares", "density_clusters", "integrated_columns", "chained_imputation", "chained_forest_imputation", "imputation_benchmark",
    "cross_validated_linear", "cross_validated_boosting", "price_anomalies",
}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(OPERATORS) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_query(spark, con, name):
    status, _, _, message = compare.compare(spark, con, name, SF_DIR)
    assert status == ("rows-only" if name in WITHOUT_ORACLE else "ok"), message
