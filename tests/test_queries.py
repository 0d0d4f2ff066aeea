"""A cross-section of the checked queries against their SQL twins (all of them run in `python -m checks.compare`)."""

import pytest

from checks.all_queries import ORACLES, QUERIES
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "agg1_aa_clone_table", "agg5_sample_summary", "fea12_core_table", "flt4_vocabulary_filter", "pub3_catalog", "pub12_leave_one_out", "stb5_stability_overview",
    "spl3_imbalance_score", "eva10_threshold_rules", "eva18_rank_biserial", "mod15_select_one_se", "join1_checked_left_join", "dq7_fingerprint",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF).startswith("ok")


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200


@pytest.mark.parametrize("name", ["join7_model_grid_completion", "eva11_model_repeat_thresholds"])
def test_query_covers_all_models(spark, con, name):
    assert compare(spark, con, name, SF).startswith("ok")
    assert QUERIES[name](spark, SF).select("model").distinct().count() > 1
