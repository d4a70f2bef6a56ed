"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores; BENCH_QUERIES (comma separated) overrides the list.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = """
trades_to_bars_5m quality_report clean_bars returns moving_averages rsi bollinger atr volatility_ratio
volatility_regime regime_transitions regime_duration hurst half_life liquidity market_beta size_factor
transition_target build_features assign_folds apply_scaler feature_profile
roc_auc optimize_threshold alerts_at_k fold_summary ledger_metrics
chain_greeks implied_vol straddle_trades delta_hedge_ledger iv_features intraday_vol daily_resample
psi performance_drift ab_compare decide_alerts governance_summary audit_checksum
stream_bars transition_label_rate
""".split()


def main() -> None:
    from tickloom.plans.catalog import QUERIES
    from tickloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    os.environ.setdefault("BENCH_SHUFFLE_PARTITIONS", cpus)
    spark = local_session("bench", cpus=cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("transition_label_rate")  # JVM and Python worker start-up is not part of any query
    times = {name: round(run(name), 3) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf)), "cpus": int(cpus) if cpus.isdigit() else cpus,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
