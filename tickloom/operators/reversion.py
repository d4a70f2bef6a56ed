"""Mean-reversion features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.blocks import rolling
from tickloom.functions.rolling import full, lag, last_n, mean_n, rows, std_n
from tickloom.operators.technical import returns as add_returns


def _z(n: int):
    close = F.col("close")
    std = std_n(close, n)
    return (close - mean_n(close, n)) / F.when(std == 0, 1.0).otherwise(std)


@rolling(lookback=lambda p: max(p["periods"]))
def zscore(bars: DataFrame, periods=(20, 50)) -> DataFrame:
    return bars.withColumns({f"MR_ZScore_{n}d": _z(n) for n in periods})


@rolling(lookback=lambda p: p["period"])
def ou_spread(bars: DataFrame, period: int = 20) -> DataFrame:
    return bars.withColumn(f"MR_OU_Spread_{period}d", _z(period))


def _with_returns(bars: DataFrame) -> DataFrame:
    return bars if "returns" in bars.columns else add_returns(bars)


@F.pandas_udf(T.DoubleType())
def _dispersion_slope(windows: pd.Series) -> pd.Series:
    """Twice the log-log slope of lagged-difference dispersion, per window of equal length."""
    out = np.full(len(windows), np.nan)
    known = windows.notna().to_numpy()
    if known.any():
        x = np.stack(windows[known].to_numpy())
        lags = np.arange(2, x.shape[1] // 2)
        spread = np.stack([np.std(x[:, k:] - x[:, :-k], axis=1) for k in lags], axis=1)
        log_lag = np.log(lags) - np.log(lags).mean()
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (np.log(spread) @ log_lag) / (log_lag @ log_lag)
        out[known] = np.where((spread > 0).all(axis=1), 2 * slope, np.nan)
    return pd.Series(out).where(np.isfinite(out), None)


@rolling(lookback=lambda p: p["window"] + 1)
def hurst(bars: DataFrame, window: int = 100) -> DataFrame:
    """Rolling Hurst exponent from the dispersion of lagged differences.

    48 lags over 100 returns per row: one bounded array per row goes through
    Arrow to numpy, which beats 48 window columns or interpreted lambdas.
    """
    bars = _with_returns(bars)
    w = last_n(window)
    history = full(F.col("returns"), w, window, F.collect_list("returns").over(w))
    return (
        bars.withColumn("_hist", history)
        .withColumn(f"MR_Hurst_{window}d", _dispersion_slope("_hist"))
        .drop("_hist")
    )


@rolling(lookback=lambda p: p["window"] + 2)
def half_life(bars: DataFrame, window: int = 50) -> DataFrame:
    """Half-life of an AR(1) fit: change of the return on the previous return."""
    bars = _with_returns(bars)
    bars = bars.withColumn("_prev", lag(F.col("returns")))
    w = rows(-(window - 2))
    step = F.col("returns") - F.col("_prev")
    slope = full(F.col("_prev"), w, window - 1, F.regr_slope(step, F.col("_prev")).over(w))
    bars = bars.withColumn("_slope", slope)
    return bars.withColumn(
        f"MR_HalfLife_{window}d",
        F.when((F.col("_slope") < 0) & (F.col("_slope") >= -2), -math.log(2) / F.col("_slope")),
    ).drop("_prev", "_slope")
