"""Registered queries against their SQL on the smallest tables (tests/check_queries.py runs them all
at any scale)."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

NAMES = [
    "table_profile", "inconsistency_report", "fair_encoding", "quantile_bins", "review_sample", "missing_by_group", "chi_square_tests", "fisher_exact",
    "proxy_detection", "point_biserial", "intersectional_tests", "bootstrap_rate_ci", "label_bias_score", "matched_counterfactual", "stratified_split",
    "attribution_divergence", "equalized_odds", "disparate_impact", "calibration_curve", "wasserstein_prob", "lipschitz_pairs", "risk_sensitivity",
    "pareto_frontier", "group_thresholds", "minority_knn", "feature_drift", "feedback_loop", "stream_di_trend",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0
