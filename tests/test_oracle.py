"""Queries against their SQL twins; TEST_ALL=1 runs every one of them."""

import os

import pytest

from compare import compare, connect
from tickloom.plans.catalog import ORACLE, QUERIES

# One or more per module; the rest runs with TEST_ALL=1 or `python tests/compare.py`.
SAMPLE = """
quality_report clean_bars holdout_features volatility_regime regime_transitions regime_duration hurst half_life
market_beta size_factor transition_target current_state sigma_breakout build_features apply_scaler feature_profile
walk_forward_windows assign_folds roc_auc average_precision optimize_threshold alerts_at_k naive_baselines
ledger_metrics drawdown_stop chain_greeks implied_vol straddle_trades delta_hedge_ledger vega_hedge daily_resample
yang_zhang_vol iv_features psi performance_drift decide_alerts audit_tampered stream_bars write_table
""".split()
NAMES = sorted(ORACLE) if os.environ.get("TEST_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], sf) == ""


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
