"""Operators on the whole feature frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import small
from tickloom.functions.blocks import BLOCK_ROWS, gather, spread
from tickloom.functions.prefix import exact_percentiles
from tickloom.functions.scalars import attach_row
from tickloom.operators import liquidity as lq
from tickloom.operators import regime as rg
from tickloom.operators import reversion as mr
from tickloom.operators import technical as ta
from tickloom.operators.cleaning import forward_fill

# Feature groups and their columns (fixed names).
GROUPS: dict[str, list[str]] = {
    "moving_average_ratios": ["MA_Ratio_5", "MA_Ratio_20", "MA_Ratio_50", "MA_Ratio_200"],
    "rsi": ["RSI"],
    "bollinger": ["BB_Mid", "BB_Upper", "BB_Lower", "BB_Width", "BB_PercentB"],
    "atr": ["ATR", "ATR_Ratio"],
    "volatility_regime": ["Volatility_20d", "Volatility_Ratio", "Vol_Regime"],
    "momentum": ["Momentum_10d", "ROC_10d"],
    "trend_regime": ["Trend_Regime"],
    "volume": ["Volume_MA_20d", "Volume_Ratio"],
    "transition": [
        "Volatility_Slope_5d", "Volatility_Acceleration_5d", "ATR_Ratio_Change_5d",
        "BB_Width_Change_5d", "Drawdown_20d", "Return_Shock_5d",
    ],
    "mean_reversion": [
        "MR_ZScore_20d", "MR_ZScore_50d", "MR_Hurst_100d", "MR_HalfLife_50d", "MR_OU_Spread_20d",
    ],
    "regime_persistence": [
        "RP_LowToLow_Prob", "RP_HighToHigh_Prob", "RP_Duration_Days", "RP_ReturnVol_Corr_60d",
    ],
    "liquidity": [
        "LQ_ADV_20d", "LQ_RelVol", "LQ_Amihud_20d", "LQ_Spread_Proxy", "LQ_Impact_Estimate",
    ],
}
ALL_GROUPS = tuple(GROUPS)
LOOKBACK = 2 * 252 + 22

_STEPS = {
    "moving_average_ratios": [ta.ma_ratios],
    "rsi": [ta.rsi],
    "bollinger": [ta.bollinger],
    "atr": [ta.atr],
    "volatility_regime": [ta.volatility_ratio, rg.volatility_regime],
    "momentum": [ta.momentum, ta.roc],
    "trend_regime": [rg.trend_regime],
    "volume": [ta.volume_features],
    "transition": [ta.volatility_dynamics, ta.range_changes, ta.drawdown, ta.return_shock],
    "mean_reversion": [mr.zscore, mr.half_life, mr.ou_spread],
    "regime_persistence": [rg.return_vol_correlation, rg.regime_transitions],
    "liquidity": [lq.liquidity],
}


def feature_names(groups=ALL_GROUPS) -> list[str]:
    return [name for g in groups for name in GROUPS[g]]


def build_features(
    bars: DataFrame,
    groups=ALL_GROUPS,
    labels=(),
    lookahead: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All feature columns of the chosen groups (and labels) in one layout.

    The series are laid out once with the longest look-back, every window then
    shares that exchange and sort, and shared inputs (returns, 20-day
    volatility, its sorted history) are computed once.  `labels` are label
    operators, for example `partial(transition_target, horizon=5)`, and
    `lookahead` is the largest of their horizons.
    """
    frame = spread(bars, LOOKBACK, lookahead, block_rows=block_rows)
    frame = ta.volatility(frame)
    if labels or {"volatility_regime", "regime_persistence"} & set(groups):
        frame = rg.volatility_quantiles(frame, (0.33, 0.67, 0.75) if labels else (0.33, 0.67))
    for group in groups:
        for step in _STEPS[group]:
            frame = step(frame)
    for label in labels:
        frame = label(frame)
    if "mean_reversion" in groups:
        # Last of the windows: a Python function ends the shared partitioning.
        frame = mr.hurst(frame)
    if "regime_persistence" in groups:
        frame = rg.regime_duration(frame)
    known = {*bars.columns, *feature_names(ALL_GROUPS), "returns", "rn", "block", "home"}
    extra = [c for c in frame.columns if c not in known and not c.startswith("_")]
    return gather(frame).select(*bars.columns, "returns", *feature_names(groups), *extra)


def fill_missing(features: DataFrame, names: list[str], method: str = "drop") -> DataFrame:
    """forward_fill (past values only), drop incomplete rows, or zero."""
    if method == "forward_fill":
        return forward_fill(features, names)
    if method == "drop":
        return features.na.drop(subset=names)
    if method == "zero":
        return features.na.fill(0, subset=names)
    raise ValueError(f"unknown method {method!r}")


def normalize(features: DataFrame, names: list[str], method: str = "zscore") -> DataFrame:
    """Global z-score or min-max scaling; a constant column stays as it is."""
    if method not in ("zscore", "minmax"):
        raise ValueError(f"unknown method {method!r}")
    aggregates = []
    for n in names:
        base, spread_ = (
            (F.avg(n), F.stddev_samp(n)) if method == "zscore" else (F.min(n), F.max(n) - F.min(n))
        )
        aggregates += [base.alias(f"_b_{n}"), spread_.alias(f"_s_{n}")]
    scaled = attach_row(features, features.agg(*aggregates))
    return scaled.select(*[
        F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_b_{c}")) / F.col(f"_s_{c}"))
        .otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in features.columns
    ])


def fit_scaler(train: DataFrame, names: list[str], keys: tuple[str, ...] = ("fold_id",)) -> DataFrame:
    """Mean and sample deviation of complete train rows; one row per fold."""
    clean = train.na.drop(subset=names)
    return clean.groupBy(*keys).agg(
        *[F.avg(n).alias(f"mean_{n}") for n in names],
        *[
            F.when(F.stddev_samp(n) > 0, F.stddev_samp(n)).otherwise(F.lit(1.0)).alias(f"std_{n}")
            for n in names
        ],
    )


def apply_scaler(rows: DataFrame, scaler: DataFrame, names: list[str], keys: tuple[str, ...] = ("fold_id",)) -> DataFrame:
    """Scale with a fitted table of one row per fold, whose size is measured before the join."""
    joined = rows.join(small(scaler), list(keys))
    return joined.select(*[
        ((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) if c in names else F.col(c)
        for c in rows.columns
    ])


def complete_rows(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    return frame.na.drop(subset=[*names, label])


def long_form(frame: DataFrame, names: list[str], keep: list[str | Column]) -> DataFrame:
    """(keep..., feature, value) with one row per feature."""
    return frame.select(*keep, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [c if isinstance(c, str) else c for c in keep], names, "feature", "value"
    )


def feature_label_correlation(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    """Absolute correlation with the label, strongest first."""
    pairs = long_form(frame.withColumn("_y", F.col(label).cast("double")), names, ["_y"]).na.drop()
    stats = pairs.groupBy("feature").agg(
        F.covar_samp("value", "_y").alias("c"),
        F.stddev_samp("value").alias("sx"), F.stddev_samp("_y").alias("sy"),
    )
    return stats.select(
        "feature", F.abs(F.try_divide("c", F.col("sx") * F.col("sy"))).alias("abs_corr")
    ).orderBy(F.desc_nulls_last("abs_corr"), "feature")


def profile(frame: DataFrame, names: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """count, nulls, mean, deviation, extremes and exact quartiles per column."""
    values = long_form(frame, names, [])
    quartiles = exact_percentiles(values, ["feature"], "value", list(probs), "_q")
    stats = values.groupBy("feature").agg(
        F.count("value").alias("n"),
        (F.count("*") - F.count("value")).alias("n_null"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return stats.join(quartiles, "feature", "left").select(
        *stats.columns, *[F.col("_q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs)]
    )
