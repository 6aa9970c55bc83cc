"""Every value-comparable query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

ROWS_ONLY = {
    "feature_matrix_full", "pca_reduce", "kmeans_sweep", "elbow_table",
    "embed_2d", "clustering_pipeline", "model_selection",
    "feature_importance", "top_importances", "umap_scatter_rows",
}


@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLE])
def test_query_matches_sql(spark, duck, sf, key):
    bad, _ = difference(spark, duck, key, sf)
    assert bad is None


def test_every_statement_has_a_query_and_the_rest_is_known():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


def test_entry_gives_one_row_per_listener(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "userid"
    assert df.count() == df.select("userid").distinct().count() > 0
