"""Queries over the feature frame, folds, scored rows and the trade ledger."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.operators import evaluate as ev
from tickloom.operators import folds, frame, labels, ledger
from tickloom.plans import views
from tickloom.plans.bar_queries import W, _full, _lag
from tickloom.plans.registry import ORACLE, query, rounded

# --- K feature frame -------------------------------------------------------------

# The assembled frame is checked against the SQL of its parts.
_PARTS = {
    "ma_ratios": 4, "rsi": 1, "bollinger": 5, "atr": 2, "volatility": 1, "volatility_ratio": 1, "volatility_regime": 1,
    "momentum": 1, "rate_of_change": 1, "trend_regime": 1, "volume_features": 2, "volatility_slope": 1,
    "volatility_acceleration": 1, "range_changes": 2, "drawdown_20d": 1, "return_shock": 1, "zscore": 2, "hurst": 1,
    "half_life": 1, "ou_spread": 1, "regime_transitions": 2, "regime_duration": 1, "return_vol_correlation": 1, "liquidity": 5,
}
_DIGITS = {n: 6 for n in frame.feature_names()} | {
    n: 4 for n in ("BB_Mid", "BB_Upper", "BB_Lower", "ATR", "Momentum_10d", "Volume_MA_20d", "LQ_ADV_20d")
} | {"MR_HalfLife_50d": 5}
_INTS = ("Vol_Regime", "Trend_Regime", "RP_Duration_Days")
_FRAME_SQL = (
    "WITH " + ", ".join(f"p_{n} AS ({ORACLE[n]})" for n in _PARTS)
    + " SELECT * FROM p_ma_ratios " + " ".join(f"JOIN p_{n} USING (symbol, bar_date)" for n in _PARTS if n != "ma_ratios")
)


def _rounded_frame(built, *more):
    built = built.withColumn("LQ_Amihud_20d", F.col("LQ_Amihud_20d") * 1e9)
    digits = {n: d for n, d in _DIGITS.items() if n not in _INTS}
    return rounded(built, digits, ("symbol", "bar_date", *_INTS, *more))


@query("build_features", _FRAME_SQL)
def build_features(spark, sf):
    return _rounded_frame(frame.build_features(views.bars_daily(spark, sf)))


_ALL_NAMES = frame.feature_names()
_ALL_CTE = f"WITH f AS (SELECT * REPLACE ({', '.join(f'{n}::DOUBLE AS {n}' for n in _INTS)}) FROM ({_FRAME_SQL}))"


def _all(spark, sf):
    """The whole frame, rounded as its SQL twin, all features as numbers of one kind."""
    return build_features(spark, sf).withColumns({n: F.col(n).cast("double") for n in _INTS})


@query("fill_missing_zero", f"{_ALL_CTE} SELECT symbol, bar_date, {', '.join(f'coalesce({n}, 0.0) AS {n}' for n in _ALL_NAMES)} FROM f")
def fill_missing_zero(spark, sf):
    return frame.fill_missing(_all(spark, sf), _ALL_NAMES, "zero")


@query("fill_missing_drop", f"{_ALL_CTE} SELECT symbol, bar_date, {', '.join(_ALL_NAMES)} FROM f WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _ALL_NAMES)}")
def fill_missing_drop(spark, sf):
    return frame.fill_missing(_all(spark, sf), _ALL_NAMES, "drop")


@query("fill_missing_forward", f"{_ALL_CTE} SELECT symbol, bar_date, {', '.join(f'last_value({n} IGNORE NULLS) OVER {W}) AS {n}' for n in _ALL_NAMES)} FROM f")
def fill_missing_forward(spark, sf):
    return frame.fill_missing(_all(spark, sf), _ALL_NAMES, "forward_fill")


def _norm_sql(base: str, span: str) -> str:
    cols = ", ".join(
        f"round(CASE WHEN {span.format(n)} > 0 THEN ({n} - {base.format(n)}) / ({span.format(n)}) ELSE {n} END, 6) + 0.0 AS {n}" for n in _ALL_NAMES
    )
    return f"{_ALL_CTE} SELECT symbol, bar_date, {cols} FROM f"


@query("normalize_zscore", _norm_sql("avg({}) OVER ()", "stddev_samp({}) OVER ()"))
def normalize_zscore(spark, sf):
    return rounded(frame.normalize(cut(_all(spark, sf)), _ALL_NAMES, "zscore"), {n: 6 for n in _ALL_NAMES})


@query("normalize_minmax", _norm_sql("min({}) OVER ()", "(max({0}) OVER () - min({0}) OVER ())"))
def normalize_minmax(spark, sf):
    return rounded(frame.normalize(cut(_all(spark, sf)), _ALL_NAMES, "minmax"), {n: 6 for n in _ALL_NAMES})


_FOLDS = views.BARS_SQL + """,
wf AS (
  SELECT CAST(k + 1 AS INTEGER) AS fold_id, f AS train_start, CAST(f + to_years(CAST(3 + k AS INTEGER)) AS DATE) AS test_start,
         CAST(f + to_years(CAST(4 + k AS INTEGER)) AS DATE) - 1 AS test_end, l
  FROM (SELECT min(bar_date) AS f, max(bar_date) AS l FROM bars) b, range(0, 50) r(k)),
folds AS (SELECT fold_id, train_start, test_start - 1 AS train_end, test_start, test_end FROM wf WHERE test_end <= l)
"""
_ASSIGNED = """,
asg AS (SELECT b.symbol, b.bar_date, fold_id, CASE WHEN bar_date <= train_end THEN 'train' ELSE 'test' END AS split
        FROM bars b JOIN folds ON bar_date BETWEEN train_start AND test_end)
"""


def _folds(bars):
    return folds.walk_forward_windows(folds.date_bounds(bars))


_SCALED = ", ".join(f"avg({n}) FILTER (WHERE split = 'train') AS m_{n}, stddev_samp({n}) FILTER (WHERE split = 'train') AS s_{n}" for n in _ALL_NAMES)
_SCALER_SQL = (
    f"{_ALL_CTE}, {_FOLDS}{_ASSIGNED}, fa AS (SELECT * FROM f JOIN asg USING (symbol, bar_date) WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _ALL_NAMES)}), "
    f"st AS (SELECT fold_id, {_SCALED} FROM fa GROUP BY fold_id)"
)


def _fold_features(spark, sf):
    rows = cut(_all(spark, sf))
    return cut(folds.assign_folds(rows, _folds(rows)))


@query("fit_scaler", f"{_SCALER_SQL} SELECT fold_id, " + ", ".join(f"round(m_{n}, 6) + 0.0 AS mean_{n}, round(CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1.0 END, 6) + 0.0 AS std_{n}" for n in _ALL_NAMES) + " FROM st")
def fit_scaler(spark, sf):
    train = _fold_features(spark, sf).filter("split = 'train'")
    scaler = frame.fit_scaler(train, _ALL_NAMES)
    return rounded(scaler, {c: 6 for c in scaler.columns if c != "fold_id"}, ("fold_id",))


@query("apply_scaler", f"{_SCALER_SQL} SELECT symbol, bar_date, fold_id, split, " + ", ".join(f"round(({n} - m_{n}) / CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1.0 END, 6) + 0.0 AS {n}" for n in _ALL_NAMES) + " FROM fa JOIN st USING (fold_id)")
def apply_scaler(spark, sf):
    rows = frame.fill_missing(_fold_features(spark, sf), _ALL_NAMES, "drop")
    scaler = frame.fit_scaler(rows.filter("split = 'train'"), _ALL_NAMES)
    scaled = frame.apply_scaler(rows, scaler, _ALL_NAMES)
    return rounded(scaled, {n: 6 for n in _ALL_NAMES}, ("symbol", "bar_date", "fold_id", "split"))


def _labelled(spark, sf, horizon: int = 1):
    built = frame.build_features(views.bars_daily(spark, sf), labels=(partial(labels.transition_target, horizon=horizon),), lookahead=horizon)
    return _rounded_frame(built, "transition").withColumns({n: F.col(n).cast("double") for n in _INTS})


_LABEL = f"l AS ({ORACLE['transition_target']}), fl AS (SELECT * FROM f JOIN l USING (symbol, bar_date))"
_COMPLETE = " AND ".join(f"{n} IS NOT NULL" for n in [*_ALL_NAMES, "transition"])


@query("complete_rows", f"{_ALL_CTE}, {_LABEL} SELECT * FROM fl WHERE {_COMPLETE}")
def complete_rows(spark, sf):
    return frame.complete_rows(_labelled(spark, sf), _ALL_NAMES, "transition")


@query(
    "feature_label_correlation",
    f"{_ALL_CTE}, {_LABEL}, lf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {n}::DOUBLE AS x, transition::DOUBLE AS y FROM fl WHERE {n} IS NOT NULL AND transition IS NOT NULL" for n in _ALL_NAMES)
    + ") SELECT feature, round(abs(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)), 6) + 0.0 AS abs_corr FROM lf GROUP BY 1",
)
def feature_label_correlation(spark, sf):
    corr = frame.feature_label_correlation(_labelled(spark, sf), _ALL_NAMES, "transition")
    return rounded(corr, {"abs_corr": 6}, ("feature",))


@query(
    "feature_profile",
    f"{_ALL_CTE}, lf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {n}::DOUBLE AS x FROM f" for n in _ALL_NAMES)
    + ") SELECT feature, count(x) AS n, count(*) - count(x) AS n_null, "
    + ", ".join(f"round({e}, 4) + 0.0 AS {c}" for c, e in {"mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "max": "max(x)", "p25": "quantile_cont(x, 0.25)", "p50": "quantile_cont(x, 0.5)", "p75": "quantile_cont(x, 0.75)"}.items())
    + " FROM lf GROUP BY 1",
)
def feature_profile(spark, sf):
    table = frame.profile(cut(_all(spark, sf)), _ALL_NAMES)
    return rounded(table, {c: 4 for c in ("mean", "std", "min", "max", "p25", "p50", "p75")}, ("feature", "n", "n_null"))


@query(
    "label_distribution",
    f"WITH l AS ({ORACLE['spike_target']}) SELECT symbol, count(*) AS known, CAST(sum(spike) AS BIGINT) AS positives, round(avg(spike), 6) + 0.0 AS positive_rate FROM l WHERE spike IS NOT NULL GROUP BY 1",
)
def label_distribution(spark, sf):
    dist = labels.label_distribution(labels.spike_target(views.bars_daily(spark, sf)), "spike")
    return rounded(dist, {"positive_rate": 6}, ("symbol", "known", "positives"))


# --- M pooling and folds ----------------------------------------------------------


@query("pooled_dataset", f"{_ALL_CTE}, l AS ({ORACLE['transition_target_5d']}) SELECT * FROM f JOIN l USING (symbol, bar_date) ORDER BY bar_date, symbol")
def pooled_dataset(spark, sf):
    return _labelled(spark, sf, horizon=5).orderBy("bar_date", "symbol")


@query("walk_forward_windows", f"WITH {_FOLDS} SELECT * FROM folds")
def walk_forward_windows(spark, sf):
    return _folds(views.bars_daily(spark, sf))


@query("assign_folds", f"WITH {_FOLDS}{_ASSIGNED} SELECT * FROM asg")
def assign_folds(spark, sf):
    bars = views.bars_daily(spark, sf)
    return folds.assign_folds(bars.select("symbol", "bar_date"), _folds(bars))


@query(
    "fold_size_guard",
    f"WITH {_FOLDS}{_ASSIGNED} SELECT symbol, fold_id, split, count(*) AS n FROM asg WHERE (symbol, fold_id) IN "
    "(SELECT (symbol, fold_id) FROM asg GROUP BY symbol, fold_id HAVING count(*) FILTER (WHERE split = 'train') >= 1100 AND count(*) FILTER (WHERE split = 'test') >= 360) GROUP BY 1, 2, 3",
)
def fold_size_guard(spark, sf):
    bars = views.bars_daily(spark, sf)
    assigned = folds.assign_folds(bars.select("symbol", "bar_date"), _folds(bars))
    kept = folds.keep_large_folds(assigned, 1100, 360, ("symbol", "fold_id"))
    return kept.groupBy("symbol", "fold_id", "split").agg(F.count("*").alias("n"))


@query("holdout_split", f"WITH {views.BARS_SQL} SELECT symbol, bar_date, CASE WHEN bar_date <= DATE '1998-12-31' THEN 'train' ELSE 'test' END AS split FROM bars WHERE bar_date <= DATE '1999-12-31'")
def holdout_split(spark, sf):
    return folds.holdout_split(views.bars_daily(spark, sf).select("symbol", "bar_date"), "1998-12-31", "1999-12-31")


# --- N5 class weights (the rest of N is in model_queries) -----------------------------


@query(
    "class_weights",
    f"WITH {views.SCORED_SQL}, c AS (SELECT symbol, count(*) AS n, sum(label) AS p FROM scored GROUP BY 1) SELECT symbol, label, count(*) AS rows, "
    "round(CASE WHEN label = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END, 6) + 0.0 AS balanced, CASE WHEN label = 1 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS fixed, "
    "round(CASE WHEN label = 1 THEN (n - p)::DOUBLE / p ELSE 1.0 END, 6) + 0.0 AS imbalance FROM scored JOIN c USING (symbol) GROUP BY symbol, label, n, p",
)
def class_weights(spark, sf):
    from tickloom.operators.models import class_weights as weigh

    rows = views.scored(spark, sf)
    for kind in ("balanced", "fixed", "imbalance"):
        rows = weigh(rows, "label", kind, ["symbol"], out=kind)
    table = rows.groupBy("symbol", "label").agg(
        F.count("*").alias("rows"), *[F.max(k).alias(k) for k in ("balanced", "fixed", "imbalance")]
    )
    return rounded(table, {k: 6 for k in ("balanced", "fixed", "imbalance")}, ("symbol", "label", "rows"))


# --- O evaluation --------------------------------------------------------------------

_SP = views.PERIODS_SQL
_MP = f"WITH {_SP}" + views.metrics_sql("sp", "model, period", "m")


@query("confusion_counts", _MP + " SELECT model, period, tn, fp, fn, tp FROM m")
def confusion_counts(spark, sf):
    return ev.confusion(views.scored_periods(spark, sf), ["model", "period"]).drop("brier")


@query("classification_metrics", _MP + ' SELECT model, period, round(accuracy, 6) + 0.0 AS accuracy, round("precision", 6) + 0.0 AS "precision", round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM m')
def classification_metrics(spark, sf):
    table = ev.classification(views.scored_periods(spark, sf), ["model", "period"])
    return rounded(table, {c: 6 for c in ("accuracy", "precision", "recall", "f1")}, ("model", "period"))


@query("roc_auc", _MP + " SELECT model, period, rows, positives, round(roc_auc, 6) + 0.0 AS roc_auc FROM m")
def roc_auc(spark, sf):
    table = ev.ranking(views.scored_periods(spark, sf), ["model", "period"])
    return rounded(table, {"roc_auc": 6}, ("model", "period", "rows", "positives"))


@query("average_precision", f"WITH {_SP}" + views.metrics_sql("sp", "model", "m") + " SELECT model, round(pr_auc, 6) + 0.0 AS pr_auc FROM m")
def average_precision(spark, sf):
    return rounded(ev.ranking(views.scored_periods(spark, sf), ["model"]), {"pr_auc": 6}, ("model",))


@query("brier_score", f"WITH {_SP} SELECT period, round(avg(pow(score - label, 2)), 6) + 0.0 AS brier FROM sp GROUP BY 1")
def brier_score(spark, sf):
    return rounded(ev.confusion(views.scored_periods(spark, sf), ["period"]), {"brier": 6}, ("period",))


_BASE_ROWS = ", bl AS (SELECT model, period, 'always_negative' AS baseline, label, 0.0 AS score, false AS pred FROM ss UNION ALL SELECT model, period, 'persistence', label, CAST(state AS DOUBLE), state = 1 FROM ss)"


@query(
    "naive_baselines",
    f"WITH {views.STATE_SQL}{_BASE_ROWS}" + views.metrics_sql("bl", "model, period, baseline", "m")
    + " SELECT model, period, baseline, tn, fp, fn, tp, round(f1, 6) + 0.0 AS f1, round(roc_auc, 6) + 0.0 AS roc_auc, round(pr_auc, 6) + 0.0 AS pr_auc FROM m",
)
def naive_baselines(spark, sf):
    table = ev.baselines(views.state_scored(spark, sf), ["model", "period"])
    return rounded(table, {c: 6 for c in ("f1", "roc_auc", "pr_auc")}, ("model", "period", "baseline", "tn", "fp", "fn", "tp"))


_CUTS = "(VALUES " + ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(ev.CUTOFFS)) + ") c(cut, threshold)"


@query(
    "optimize_threshold",
    f"WITH {_SP}, cv AS (SELECT model, cut, threshold, count(*) FILTER (WHERE score >= threshold) AS predicted, sum(label) FILTER (WHERE score >= threshold) AS tp, sum(label) AS p FROM sp, {_CUTS} WHERE period < 1999 GROUP BY 1, 2, 3), "
    "fb AS (SELECT *, coalesce(5 * coalesce(tp, 0) / nullif(4 * p + predicted, 0)::DOUBLE, 0.0) AS f2 FROM cv) "
    "SELECT model, round(threshold, 6) + 0.0 AS threshold, round(f2, 6) + 0.0 AS f_beta FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f2 DESC, cut) AS place FROM fb) t WHERE place = 1",
)
def optimize_threshold(spark, sf):
    train = views.scored_periods(spark, sf).filter("period < 1999")
    return rounded(ev.optimize_threshold(train, ["model"]), {"threshold": 6, "f_beta": 6}, ("model",))


_AT_K = " UNION ALL ".join(
    f"SELECT model, period, {f}::DOUBLE AS fraction, greatest(1, CAST(ceil(n * {f}) AS BIGINT)) AS alerts, sum(label) AS hits FROM {views.top_sql('sp', 'model, period', f'greatest(1, ceil(n * {f}))')} x GROUP BY model, period, n"
    for f in ev.ALERT_FRACTIONS
)


@query(
    "alerts_at_k",
    f"WITH {_SP}, k AS ({_AT_K}), b AS (SELECT model, period, sum(label) AS p, avg(label) AS rate FROM sp GROUP BY 1, 2) "
    "SELECT model, period, fraction, CAST(alerts AS BIGINT) AS alerts, round(hits / alerts::DOUBLE, 6) + 0.0 AS precision_at_k, round(coalesce(hits / nullif(p, 0)::DOUBLE, 0.0), 6) + 0.0 AS recall_at_k, "
    "round(coalesce(hits / alerts::DOUBLE / nullif(rate, 0), 0.0), 6) + 0.0 AS lift FROM k JOIN b USING (model, period)",
)
def alerts_at_k(spark, sf):
    table = ev.alerts_at_k(views.scored_periods(spark, sf), ["model", "period"])
    return rounded(table, {c: 6 for c in ("precision_at_k", "recall_at_k", "lift")}, ("model", "period", "fraction", "alerts"))


@query("per_symbol_metrics", f"WITH {_SP}" + views.metrics_sql("sp", "period, symbol", "m") + " SELECT period, symbol, round(f1, 6) + 0.0 AS f1, round(pr_auc, 6) + 0.0 AS pr_auc FROM m")
def per_symbol_metrics(spark, sf):
    return rounded(ev.evaluate(views.scored_periods(spark, sf), ["period", "symbol"]), {"f1": 6, "pr_auc": 6}, ("period", "symbol"))


@query("per_year_metrics", f"WITH {_SP}" + views.metrics_sql("sp", "period", "m") + " SELECT period AS year, round(f1, 6) + 0.0 AS f1, round(pr_auc, 6) + 0.0 AS pr_auc, round(positives / rows::DOUBLE, 6) + 0.0 AS positive_rate FROM m")
def per_year_metrics(spark, sf):
    rows = views.scored_periods(spark, sf).withColumn("year", F.year("bar_date"))
    table = ev.evaluate(rows, ["year"]).withColumn("positive_rate", F.col("positives") / F.col("rows"))
    return rounded(table, {"f1": 6, "pr_auc": 6, "positive_rate": 6}, ("year",))


_RULE_FEATURES = views.LABEL_SQL + f""",
rf AS (
  SELECT symbol, bar_date, CAST(year(bar_date) AS INTEGER) AS period, label, vol - {_lag('vol', 5)} AS slope,
         {_full('max(abs(returns))', 'returns', 5)} AS shock, w - {_lag('w', 5)} AS widening
  FROM (SELECT *, 4 * ({_full('stddev_samp(close)', 'close', 20)}) / ({_full('avg(close)', 'close', 20)}) AS w FROM lab) t),
rt AS (SELECT *, quantile_cont(shock, 0.9) OVER (PARTITION BY period) AS p90 FROM rf WHERE label IS NOT NULL),
rr AS (SELECT period, 'volatility_slope_positive' AS rule, label, slope > 0 AS pred FROM rt
       UNION ALL SELECT period, 'return_shock_high', label, shock >= p90 FROM rt
       UNION ALL SELECT period, 'bb_width_expanding', label, widening > 0 FROM rt),
rs AS (SELECT period, rule, label, coalesce(pred, false) AS pred, CAST(coalesce(pred, false) AS DOUBLE) AS score FROM rr)
"""


def rule_rows(spark, sf):
    built = frame.build_features(views.bars_daily(spark, sf), ("transition",), labels=(labels.transition_target,), lookahead=1)
    return cut(built.filter("transition IS NOT NULL").select(
        "symbol", "bar_date", F.year("bar_date").alias("period"), F.col("transition").alias("label"),
        "Volatility_Slope_5d", "Return_Shock_5d", "BB_Width_Change_5d",
    ))


@query("rule_baselines", f"WITH {_RULE_FEATURES}" + views.metrics_sql("rs", "period, rule", "m") + " SELECT period, rule, round(f1, 6) + 0.0 AS f1, round(pr_auc, 6) + 0.0 AS pr_auc FROM m")
def rule_baselines(spark, sf):
    return rounded(ev.rule_baselines(rule_rows(spark, sf), ["period"]), {"f1": 6, "pr_auc": 6}, ("period", "rule"))


@query("ranked_alerts", f"WITH {_SP} SELECT symbol, bar_date, label, round(score, 8) + 0.0 AS score FROM sp ORDER BY score DESC, symbol, bar_date")
def ranked_alerts(spark, sf):
    return rounded(ev.ranked_alerts(views.scored(spark, sf)), {"score": 8}, ("symbol", "bar_date", "label"))


_PCT = " UNION ALL ".join(
    f"SELECT model, CAST({p} AS INTEGER) AS percent, greatest(1, CAST(floor(n * {p} / 100.0) AS BIGINT)) AS rows, avg(label) AS prec FROM {views.top_sql('sp', 'model', f'greatest(1, floor(n * {p} / 100.0))')} x GROUP BY model, n"
    for p in (1, 5, 10)
)


@query("precision_at_percent", f'WITH {_SP}, k AS ({_PCT}) SELECT model, percent, CAST(rows AS BIGINT) AS rows, round(prec, 6) + 0.0 AS "precision" FROM k')
def precision_at_percent(spark, sf):
    table = ev.precision_at_percent(views.scored_periods(spark, sf), ["model"])
    return rounded(table, {"precision": 6}, ("model", "percent", "rows"))


_FM_DIGITS = {c: 6 for c in ("accuracy", "precision", "recall", "f1", "pr_auc", "brier", "precision_at_5pct", "lift_1pct", "positive_rate", "baseline_f1")}


@query("fold_summary", f"WITH {views.FOLD_METRICS_SQL} SELECT model, period, horizon, rows, positives, " + ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in _FM_DIGITS) + " FROM fm")
def fold_summary(spark, sf):
    return rounded(views.fold_metrics(spark, sf), _FM_DIGITS, ("model", "period", "horizon", "rows", "positives"))


_MEANS = ("f1", "pr_auc", "brier", "baseline_f1")


@query(
    "compare_models",
    f"WITH {views.FOLD_METRICS_SQL}, a AS (SELECT model, " + ", ".join(f"avg({c}) AS mean_{c}" for c in _MEANS) + " FROM fm GROUP BY 1) "
    "SELECT model, " + ", ".join(f"round(mean_{c}, 6) + 0.0 AS mean_{c}" for c in _MEANS) + ", row_number() OVER (ORDER BY mean_f1 DESC, model DESC) = 1 AS best FROM a",
)
def compare_models(spark, sf):
    return rounded(ev.compare_models(views.fold_metrics(spark, sf)), {f"mean_{c}": 6 for c in _MEANS}, ("model", "best"))


@query(
    "pooled_highlights",
    f"WITH {views.FOLD_METRICS_SQL}, k AS ({_AT_K}), al AS (SELECT model, period, fraction, coalesce(hits / alerts::DOUBLE / nullif(positive_rate, 0), 0.0) AS lift FROM k JOIN fm USING (model, period)), "
    f"b1 AS (SELECT model AS best_model, horizon, period, f1 AS best_f1 FROM fm ORDER BY f1 DESC, model DESC, horizon DESC, period DESC LIMIT 1), "
    "b2 AS (SELECT lift AS best_lift, model AS lift_model, fraction AS lift_fraction FROM al ORDER BY lift DESC, model DESC, period DESC, fraction DESC LIMIT 1), "
    f"rules AS ({ORACLE['rule_baselines']}), b3 AS (SELECT rule AS best_rule, f1 AS best_rule_f1 FROM rules WHERE period = (SELECT period FROM b1) ORDER BY f1 DESC, rule DESC LIMIT 1), "
    "pr AS (SELECT period, avg(positive_rate) AS r FROM fm GROUP BY 1), b4 AS (SELECT min_by(r, period) AS first_positive_rate, max_by(r, period) AS last_positive_rate FROM pr) "
    "SELECT best_model, horizon, period, round(best_f1, 6) AS best_f1, round(best_lift, 6) AS best_lift, lift_model, lift_fraction, best_rule, round(best_rule_f1, 6) AS best_rule_f1, "
    "round(first_positive_rate, 6) AS first_positive_rate, round(last_positive_rate, 6) AS last_positive_rate FROM b1, b2, b3, b4",
)
def pooled_highlights(spark, sf):
    rows = views.state_scored(spark, sf)
    summary = views.fold_metrics(spark, sf, rows)
    alerts = ev.alerts_at_k(rows, ["model", "period"])
    rules = ev.rule_baselines(rule_rows(spark, sf), ["period"]).withColumn("horizon", F.lit(1))
    row = ev.pooled_highlights(summary, alerts, rules)
    return rounded(
        row, {c: 6 for c in ("best_f1", "best_lift", "best_rule_f1", "first_positive_rate", "last_positive_rate")},
        ("best_model", "horizon", "period", "lift_model", "lift_fraction", "best_rule"),
    )


# The horizon as a dimension: labels of all horizons laid out once and stacked, metrics by (model, horizon, period).

_FM_NAMES = ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in _FM_DIGITS)


@query("fold_summary_horizons", f"WITH {views.HORIZON_SQL} SELECT model, period, horizon, rows, positives, {_FM_NAMES} FROM fm")
def fold_summary_horizons(spark, sf):
    return rounded(views.horizon_metrics(spark, sf), _FM_DIGITS, ("model", "period", "horizon", "rows", "positives"))


@query(
    "compare_models_horizons",
    f"WITH {views.HORIZON_SQL}, a AS (SELECT model, horizon, " + ", ".join(f"avg({c}) AS mean_{c}" for c in _MEANS) + " FROM fm GROUP BY 1, 2) "
    "SELECT model, horizon, " + ", ".join(f"round(mean_{c}, 6) + 0.0 AS mean_{c}" for c in _MEANS) + ", row_number() OVER (ORDER BY mean_f1 DESC, model DESC, horizon DESC) = 1 AS best FROM a",
)
def compare_models_horizons(spark, sf):
    table = ev.compare_models(views.horizon_metrics(spark, sf), ("model", "horizon"))
    return rounded(table, {f"mean_{c}": 6 for c in _MEANS}, ("model", "horizon", "best"))


@query(
    "pooled_dataset_horizons",
    f"{_ALL_CTE}, l AS (" + " UNION ALL ".join(f"SELECT symbol, bar_date, {h} AS horizon, transition AS label FROM ({ORACLE[name]})" for h, name in ((1, "transition_target"), (5, "transition_target_5d")))
    + ") SELECT * FROM f JOIN l USING (symbol, bar_date) WHERE label IS NOT NULL",
)
def pooled_dataset_horizons(spark, sf):
    """Features once, one row for each horizon whose label is known."""
    built = frame.build_features(views.bars_daily(spark, sf), labels=(partial(labels.transition_targets, horizons=views.HORIZONS),), lookahead=max(views.HORIZONS))
    whole = _rounded_frame(built, *[f"transition_{h}" for h in views.HORIZONS]).withColumns({n: F.col(n).cast("double") for n in _INTS})
    return labels.stack_horizons(whole, views.HORIZONS)


_H_AT_K = " UNION ALL ".join(
    f"SELECT model, horizon, period, {f}::DOUBLE AS fraction, greatest(1, CAST(ceil(n * {f}) AS BIGINT)) AS alerts, sum(label) AS hits FROM {views.top_sql('ss', 'model, horizon, period', f'greatest(1, ceil(n * {f}))')} x GROUP BY model, horizon, period, n"
    for f in ev.ALERT_FRACTIONS
)
_H_RULES = f""",
rf AS (
  SELECT symbol, bar_date, vol - {_lag('vol', 5)} AS slope, {_full('max(abs(returns))', 'returns', 5)} AS shock, w - {_lag('w', 5)} AS widening
  FROM (SELECT *, 4 * ({_full('stddev_samp(close)', 'close', 20)}) / ({_full('avg(close)', 'close', 20)}) AS w FROM hi) t),
rt AS (SELECT *, quantile_cont(shock, 0.9) OVER (PARTITION BY horizon, period) AS p90 FROM (
  SELECT rf.*, horizon, label, CAST(year(bar_date) AS INTEGER) AS period FROM rf JOIN (SELECT symbol, bar_date, horizon, label FROM lab) x USING (symbol, bar_date) WHERE label IS NOT NULL) y),
rr AS (SELECT horizon, period, 'volatility_slope_positive' AS rule, label, slope > 0 AS pred FROM rt
       UNION ALL SELECT horizon, period, 'return_shock_high', label, shock >= p90 FROM rt
       UNION ALL SELECT horizon, period, 'bb_width_expanding', label, widening > 0 FROM rt),
rs AS (SELECT horizon, period, rule, label, coalesce(pred, false) AS pred, CAST(coalesce(pred, false) AS DOUBLE) AS score FROM rr)
"""


@query(
    "pooled_highlights_horizons",
    f"WITH {views.HORIZON_SQL}{_H_RULES}" + views.metrics_sql("rs", "horizon, period, rule", "rm") + f", k AS ({_H_AT_K}), "
    "al AS (SELECT model, horizon, period, fraction, coalesce(hits / alerts::DOUBLE / nullif(positive_rate, 0), 0.0) AS lift FROM k JOIN fm USING (model, horizon, period)), "
    "b1 AS (SELECT model AS best_model, horizon, period, f1 AS best_f1 FROM fm ORDER BY f1 DESC, model DESC, horizon DESC, period DESC LIMIT 1), "
    "b2 AS (SELECT lift AS best_lift, model AS lift_model, fraction AS lift_fraction FROM al ORDER BY lift DESC, model DESC, period DESC, fraction DESC LIMIT 1), "
    "b3 AS (SELECT rule AS best_rule, f1 AS best_rule_f1 FROM rm WHERE (horizon, period) = (SELECT (horizon, period) FROM b1) ORDER BY f1 DESC, rule DESC LIMIT 1), "
    "pr AS (SELECT period, avg(positive_rate) AS r FROM fm GROUP BY 1), b4 AS (SELECT min_by(r, period) AS first_positive_rate, max_by(r, period) AS last_positive_rate FROM pr) "
    "SELECT best_model, horizon, period, round(best_f1, 6) AS best_f1, round(best_lift, 6) AS best_lift, lift_model, lift_fraction, best_rule, round(best_rule_f1, 6) AS best_rule_f1, "
    "round(first_positive_rate, 6) AS first_positive_rate, round(last_positive_rate, 6) AS last_positive_rate FROM b1, b2, b3, b4",
)
def pooled_highlights_horizons(spark, sf):
    rows = views.horizon_scored(spark, sf)
    summary = views.horizon_metrics(spark, sf, rows)
    alerts = ev.alerts_at_k(rows, ["model", "horizon", "period"])
    built = frame.build_features(views.bars_daily(spark, sf), ("transition",), labels=(partial(labels.transition_targets, horizons=views.HORIZONS),), lookahead=max(views.HORIZONS))
    wanted = built.select("symbol", "bar_date", F.year("bar_date").alias("period"), "Volatility_Slope_5d", "Return_Shock_5d", "BB_Width_Change_5d", *[f"transition_{h}" for h in views.HORIZONS])
    rules = ev.rule_baselines(cut(labels.stack_horizons(wanted, views.HORIZONS)), ["horizon", "period"])
    return rounded(
        ev.pooled_highlights(summary, alerts, rules), {c: 6 for c in ("best_f1", "best_lift", "best_rule_f1", "first_positive_rate", "last_positive_rate")},
        ("best_model", "horizon", "period", "lift_model", "lift_fraction", "best_rule"),
    )


_REGIMES = f"""WITH {views.FOLD_METRICS_SQL},
fv AS (SELECT model, period, stddev_samp(returns) * sqrt(252.0) AS v FROM ss GROUP BY 1, 2),
fr AS (SELECT *, CASE WHEN v <= (SELECT quantile_cont(v, 0.3333) FROM fv) THEN 'Low' WHEN v <= (SELECT quantile_cont(v, 0.6667) FROM fv) THEN 'Medium' ELSE 'High' END AS regime FROM fv)
"""


def _fold_regimes(rows):
    return ev.fold_regimes(rows, rows.select("model", "period").distinct(), ["model", "period"])


@query("fold_vol_regimes", f"{_REGIMES} SELECT model, period, round(v, 6) + 0.0 AS realised_vol, regime FROM fr")
def fold_vol_regimes(spark, sf):
    return rounded(_fold_regimes(views.state_scored(spark, sf)), {"realised_vol": 6}, ("model", "period", "regime"))


_RR = {"avg_f1": "avg(f1)", "avg_pr_auc": "avg(pr_auc)", "avg_precision_at_5pct": "avg(precision_at_5pct)", "avg_positive_rate": "avg(positive_rate)", "max_f1": "max(f1)", "min_f1": "min(f1)"}


@query("regime_report", f"{_REGIMES} SELECT regime, count(*) AS folds, " + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in _RR.items()) + " FROM fm JOIN fr USING (model, period) GROUP BY 1")
def regime_report(spark, sf):
    rows = views.state_scored(spark, sf)
    report = ev.regime_report(views.fold_metrics(spark, sf, rows), _fold_regimes(rows), ["model", "period"])
    return rounded(report, {c: 6 for c in _RR}, ("regime", "folds"))


# --- P ledger ---------------------------------------------------------------------------

_G = "(PARTITION BY model, period ORDER BY bar_date"
_SIGNALS = _SP + f""",
nx AS (SELECT *, lead(close) OVER {_G}) AS exit_price FROM sp),
cand AS (
  SELECT *, abs(exit_price / close - 1) - vol - 0.002 AS pnl_pct, least(1000.0 / greatest(vol, 0.001) * 0.02 * score, 10000.0) AS size
  FROM nx WHERE pred AND score >= 0.55 AND exit_price IS NOT NULL)
"""
_LEDGER = """,
cum AS (SELECT *, size * pnl_pct AS pnl, coalesce(sum(size * pnl_pct) OVER (PARTITION BY {g} ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prior FROM cand),
br AS (SELECT *, max(CASE WHEN prior / 100000.0 < -{limit} THEN 1 ELSE 0 END) OVER (PARTITION BY {g} ORDER BY bar_date) AS stopped FROM cum),
tr AS (SELECT *, sum(pnl) OVER (PARTITION BY {g} ORDER BY bar_date) / 100000.0 AS equity_return FROM br WHERE stopped = 0 AND size > 0)
"""
_LP = _LEDGER.format(g="model, period", limit=0.2)


def _rows(spark, sf):
    return views.scored_periods(spark, sf)


@query("trade_pnl", f"WITH {_SIGNALS} SELECT model, period, bar_date, round(pnl_pct, 6) + 0.0 AS pnl_pct FROM cand")
def trade_pnl(spark, sf):
    trades = ledger.trade_candidates(_rows(spark, sf), ["model", "period"], F.lit(ledger.FIXED_POSITION))
    return rounded(trades, {"pnl_pct": 6}, ("model", "period", "bar_date"))


@query("position_size", f"WITH {_SIGNALS} SELECT model, period, bar_date, round(size, 4) + 0.0 AS kelly_size, 2000.0::DOUBLE AS fixed_size FROM cand")
def position_size(spark, sf):
    trades = ledger.trade_candidates(_rows(spark, sf), ["model", "period"], F.lit(ledger.FIXED_POSITION))
    fixed = ledger.position_size(F.col("score"), F.col("Volatility_20d"), F.lit(0.02), "fixed")
    sized = trades.withColumnRenamed("position_size", "kelly_size").withColumn("fixed_size", fixed)
    return rounded(sized, {"kelly_size": 4, "fixed_size": 4}, ("model", "period", "bar_date"))


_KELLY = """,
ks AS (SELECT model, period, count(*) AS trades, count(*) FILTER (WHERE pnl_pct > 0) AS w, count(*) FILTER (WHERE pnl_pct < 0) AS l,
              avg(pnl_pct) FILTER (WHERE pnl_pct > 0) AS aw, abs(avg(pnl_pct) FILTER (WHERE pnl_pct < 0)) AS al FROM tr GROUP BY 1, 2),
kf AS (SELECT model, period, trades, CASE WHEN trades < 10 OR w = 0 OR l = 0 THEN 0.02
       ELSE greatest(0.0, least(0.25 * ((w / trades::DOUBLE) * (aw / al) - (1 - w / trades::DOUBLE)) / (aw / al), 0.1)) END AS kelly FROM ks)
"""


@query("kelly_fraction", f"WITH {_SIGNALS}{_LP}{_KELLY} SELECT model, period, trades, round(kelly, 6) + 0.0 AS kelly FROM kf")
def kelly_fraction(spark, sf):
    trades = ledger.run_ledger(_rows(spark, sf), ["model", "period"])
    return rounded(ledger.kelly_fraction(trades, ["model", "period"]), {"kelly": 6}, ("model", "period", "trades"))


@query("drawdown_stop", f"WITH {_SIGNALS}{_LEDGER.format(g='model', limit=0.002)} SELECT model, bar_date, round(equity_return, 8) + 0.0 AS equity_return FROM tr")
def drawdown_stop(spark, sf):
    """A tight limit over all periods, so that the stop takes effect."""
    keyed = ledger.trade_candidates(_rows(spark, sf), ["model", "period"], F.lit(ledger.FIXED_POSITION))
    stopped = ledger.apply_stop(keyed, ["model"], max_drawdown=0.002)
    return rounded(stopped, {"equity_return": 8}, ("model", "bar_date"))


@query("equity_curve", f"WITH {_SIGNALS}{_LP} SELECT model, period, bar_date, round(size, 4) + 0.0 AS position_size, round(pnl, 4) + 0.0 AS pnl, round(equity_return, 8) + 0.0 AS equity_return FROM tr")
def equity_curve(spark, sf):
    trades = ledger.run_ledger(_rows(spark, sf), ["model", "period"])
    return rounded(trades, {"position_size": 4, "pnl": 4, "equity_return": 8}, ("model", "period", "bar_date"))


_STEPS = f""",
cu AS (SELECT *, 1 + equity_return AS eq, coalesce(lag(1 + equity_return) OVER {_G}), 1.0) AS eq0, greatest(max(1 + equity_return) OVER {_G}), 1.0) AS peak FROM tr),
sx AS (SELECT *, eq / eq0 - 1 AS step, eq / peak - 1 AS down FROM cu)
"""
_METRICS = {
    "win_rate": "avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END)",
    "avg_win": "coalesce(avg(pnl_pct) FILTER (WHERE pnl_pct > 0), 0.0)",
    "avg_loss": "coalesce(abs(avg(pnl_pct) FILTER (WHERE pnl_pct < 0)), 0.0)",
    "profit_factor": "coalesce(coalesce(sum(pnl_pct) FILTER (WHERE pnl_pct > 0), 0.0) / nullif(abs(sum(pnl_pct) FILTER (WHERE pnl_pct < 0)), 0), 0.0)",
    "total_return": "max_by(equity_return, bar_date)",
    "annual_return": "CASE WHEN count(*) < 252 THEN max_by(equity_return, bar_date) * 252.0 / count(*) ELSE max_by(equity_return, bar_date) END",
    "sharpe_ratio": "coalesce((avg(step) - 0.05 / 252) / nullif(stddev_pop(step), 0) * sqrt(252.0), 0.0)",
    "sortino_ratio": "coalesce((avg(step) - 0.05 / 252) / nullif(stddev_pop(step) FILTER (WHERE step < 0), 0) * sqrt(252.0), 0.0)",
    "max_drawdown": "least(min(down), 0.0)",
}


@query(
    "ledger_metrics",
    f"WITH {_SIGNALS}{_LP}{_STEPS} SELECT model, period, count(*) AS total_trades, count(*) FILTER (WHERE pnl_pct > 0) AS winning_trades, count(*) FILTER (WHERE pnl_pct < 0) AS losing_trades, "
    + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in _METRICS.items()) + " FROM sx GROUP BY 1, 2",
)
def ledger_metrics(spark, sf):
    trades = ledger.run_ledger(_rows(spark, sf), ["model", "period"])
    table = ledger.ledger_metrics(trades, ["model", "period"])
    return rounded(table, {c: 6 for c in _METRICS}, ("model", "period", "total_trades", "winning_trades", "losing_trades"))
