"""Volatility and trend regimes and their persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.blocks import gather, rolling, spread
from tickloom.functions.prefix import running
from tickloom.functions.rolling import (
    full, lag, last_n, mean_n, quantile_of_sorted, ratio, rows,
)
from tickloom.operators.technical import volatility


def sorted_history(bars: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """The last n values in ascending order (NULL until n are known)."""
    w = last_n(n)
    return bars.withColumn(out, full(F.col(value), w, n, F.sort_array(F.collect_list(value).over(w))))


def quantile_name(p: float, window: int) -> str:
    return f"_vol_q{round(p * 1000)}_{window}"


def volatility_quantiles(bars: DataFrame, probs, window: int = 252) -> DataFrame:
    """Rolling quantiles of the volatility, NULL until the window is full.

    All of them are read from one sorted array, which is dropped right away so
    that later windows do not carry it.
    """
    bars = with_volatility(bars)
    missing = [p for p in probs if quantile_name(p, window) not in bars.columns]
    if not missing:
        return bars
    bars = sorted_history(bars, "Volatility_20d", window, "_history")
    return bars.withColumns(
        {quantile_name(p, window): quantile_of_sorted(F.col("_history"), p, window) for p in missing}
    ).drop("_history")


def with_volatility(bars: DataFrame) -> DataFrame:
    return bars if "Volatility_20d" in bars.columns else volatility(bars)


@rolling(lookback=lambda p: p["window"] + 21)
def volatility_regime(bars: DataFrame, window: int = 252, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """1 below the low rolling quantile, 3 above the high one, else 2."""
    given = bars.columns
    bars = volatility_quantiles(bars, (low, high), window)
    vol, names = F.col("Volatility_20d"), [quantile_name(p, window) for p in (low, high)]
    bars = bars.withColumn(
        "Vol_Regime", F.when(vol < F.col(names[0]), 1).when(vol > F.col(names[1]), 3).otherwise(2)
    )
    return bars.drop(*[n for n in names if n not in given])


@rolling(lookback=50)
def trend_regime(bars: DataFrame) -> DataFrame:
    above = F.col("close") > mean_n(F.col("close"), 50)
    return bars.withColumn("Trend_Regime", F.coalesce(above, F.lit(False)).cast("int"))


def _with_regime(bars: DataFrame) -> DataFrame:
    return bars if "Vol_Regime" in bars.columns else volatility_regime(bars)


@rolling(lookback=lambda p: 2 * 252 + 22)
def regime_transitions(bars: DataFrame, window: int = 252) -> DataFrame:
    """Probability of staying in the low / high regime over the rows before this one."""
    bars = _with_regime(bars)
    regime = F.col("Vol_Regime")
    bars = bars.withColumn("_before", lag(regime))
    out = {}
    for name, state in (("RP_LowToLow_Prob", 1), ("RP_HighToHigh_Prob", 3)):
        stayed = F.sum(((regime == state) & (F.col("_before") == state)).cast("double"))
        left = F.sum((regime == state).cast("double"))
        probability = stayed.over(rows(-(window - 1), -1)) / F.greatest(left.over(rows(-window, -2)), F.lit(1.0))
        out[name] = F.when(F.col("rn") > window, probability)
    return bars.withColumns(out).drop("_before")


def regime_duration(bars: DataFrame) -> DataFrame:
    """1-based position inside the current run of equal regimes.

    Runs have no length limit, so the start of the run is carried between
    blocks as a running maximum instead of being searched in a window.
    """
    laid_out = "block" in bars.columns
    if not laid_out:
        bars = _with_regime(spread(bars, 2 * 252 + 22))
    regime = F.col("Vol_Regime")
    changed = F.coalesce(regime != lag(regime), F.lit(True))
    marked = bars.withColumn("_start", F.when(changed, F.col("rn"))).filter("home")
    # Home rows lie in their own block, so the layout's exchange and sort are reused.
    carried = running(
        marked, ["symbol"], F.col("block"), [F.col("bar_date")], maxima={"_run": F.col("_start")}
    )
    result = carried.withColumn("RP_Duration_Days", F.col("rn") - F.col("_run") + 1).drop("_start", "_run")
    return result if laid_out else gather(result)


@rolling(lookback=lambda p: p["window"] + 21)
def return_vol_correlation(bars: DataFrame, window: int = 60) -> DataFrame:
    bars = with_volatility(bars).withColumn("_abs", F.abs("returns"))
    known = F.when(F.col("Volatility_20d").isNotNull(), F.col("_abs"))
    w = last_n(window)
    covariance = F.covar_samp("_abs", "Volatility_20d").over(w)
    spread_ = F.stddev_samp(known).over(w) * F.stddev_samp("Volatility_20d").over(w)
    return bars.withColumn(
        f"RP_ReturnVol_Corr_{window}d",
        full(known, w, window, ratio(covariance, spread_)),
    ).drop("_abs")
