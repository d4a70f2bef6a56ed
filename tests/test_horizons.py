"""Labels and metrics with the horizon as a dimension."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.operators import evaluate, factors, labels


def bars(spark, n=420, seed=2):
    rng = random.Random(seed)
    rows = []
    for s in "AB":
        close = 100.0
        for i in range(n):
            close *= 1 + rng.gauss(0, 0.05 if (i // 30) % 3 == 0 else 0.01)
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), close, close * 1.01, close * 0.99, close, 1000.0 + i % 7))
    return spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume double")


def test_stacked_horizons_equal_single_targets(spark):
    b = bars(spark)
    stacked = labels.stack_horizons(labels.transition_targets(b, horizons=(1, 5)).select("symbol", "bar_date", "transition_1", "transition_5"))
    got = {(r.symbol, r.bar_date, r.horizon): r.label for r in stacked.collect()}
    want = {}
    for h in (1, 5):
        for r in labels.transition_target(b, horizon=h).filter("transition IS NOT NULL").collect():
            want[r.symbol, r.bar_date, h] = r.transition
    assert got == want and sum(got.values()) > 0 and stacked.columns == ["symbol", "bar_date", "horizon", "label"]


def test_best_over_models_and_horizons(spark):
    rows = [("m", 1, 0.2, 0.0, 0.0, 0.0), ("m", 5, 0.4, 0.0, 0.0, 0.0), ("m", 5, 0.6, 0.0, 0.0, 0.0), ("n", 5, 0.5, 0.0, 0.0, 0.0)]
    table = evaluate.compare_models(spark.createDataFrame(rows, "model string, horizon int, f1 double, pr_auc double, brier double, baseline_f1 double"), ("model", "horizon"))
    assert {(r.model, r.horizon): (round(r.mean_f1, 9), r.best) for r in table.collect()} == {("m", 1): (0.2, False), ("m", 5): (0.5, False), ("n", 5): (0.5, True)}


def test_size_factor_is_the_average_rank(spark):
    got = factors.size_proxy(bars(spark), window=40)
    rows = got.filter("symbol = 'A'").orderBy("bar_date").select("Volatility_20d", "Size_Factor").collect()
    vol = [r.Volatility_20d for r in rows]
    checked = 0
    for i, r in enumerate(rows):
        own = vol[max(0, i - 39):i + 1]
        if len(own) == 40 and None not in own:
            below, equal = sum(v < vol[i] for v in own), sum(v == vol[i] for v in own)
            assert abs(r.Size_Factor - (below + (equal + 1) / 2) / 40) < 1e-12
            checked += 1
        else:
            assert r.Size_Factor is None
    assert checked > 300
