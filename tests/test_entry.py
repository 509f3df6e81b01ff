import importlib

import pytest

from rfmspark.plans.oracle_check import check


def test_entry_and_contract(spark):
    e = importlib.import_module("__spark_entry__")
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["rfm_features", "cleaning_audit", "segment_distribution", "drift_report",
                                  "model_metrics", "quantile_histogram", "knn_self_join"])
def test_oracle_at_smallest_scale(spark, name):
    assert check(spark, "/root/testdata/sf0.001", [name], verbose=False)[name] == "OK"
