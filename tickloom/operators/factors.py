"""Factor exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.blocks import rolling
from tickloom.functions.rolling import full, max_n, min_n, rows
from tickloom.operators.regime import sorted_history, with_volatility
from tickloom.operators.technical import returns as add_returns


def market_returns(bars: DataFrame) -> DataFrame:
    """Equal-weighted mean return per date."""
    return add_returns(bars).groupBy("bar_date").agg(F.avg("returns").alias("market_return"))


@rolling(lookback=lambda p: p["window"])
def _beta(bars: DataFrame, window: int) -> DataFrame:
    known = (F.col("returns") + F.col("market_return")).isNotNull()
    x = F.when(known, F.col("market_return"))
    y = F.when(known, F.col("returns"))
    w = rows(-window, -1)
    bars = bars.withColumns({
        "Market_Beta": full(y, w, window, F.regr_slope(y, x).over(w)),
        "_vy": F.var_pop(y).over(w),
        "_vx": F.var_pop(x).over(w),
    })
    # Least squares: var(y - beta x) = var(y) - beta^2 var(x).
    rest = F.col("_vy") - F.col("Market_Beta") * F.col("Market_Beta") * F.col("_vx")
    return bars.withColumn(
        "Residual_Vol", F.when(F.col("Market_Beta").isNotNull(), F.sqrt(F.greatest(rest, F.lit(0.0))))
    ).drop("_vy", "_vx")


def market_beta(bars: DataFrame, market: DataFrame | None = None, window: int = 60) -> DataFrame:
    """Slope on the market return and residual dispersion over the rows before this one.

    The market table has one row per date; whether it is broadcast is left to
    the size check of adaptive execution.
    """
    market = market_returns(bars) if market is None else market
    joined = add_returns(bars).join(market, "bar_date", "left")
    return _beta(joined, window)


@rolling(lookback=lambda p: p["window"] + 21)
def size_proxy(bars: DataFrame, window: int = 252) -> DataFrame:
    """Average-rank percentile of the current volatility in its own window."""
    history = "_history"
    bars = sorted_history(with_volatility(bars), "Volatility_20d", window, history)
    # In an ordered window the first place from either end counts what is below and what is above; no pass per element.
    below = F.array_position(history, F.col("Volatility_20d")) - 1
    above = F.array_position(F.reverse(history), F.col("Volatility_20d")) - 1
    rank = F.when(F.col(history).isNotNull(), (below + (window - below - above + 1) / 2) / window)
    return bars.withColumn("Size_Factor", rank).drop(history)


@rolling(lookback=lambda p: p["window"])
def value_proxy(bars: DataFrame, window: int = 252) -> DataFrame:
    """Position of the close within its range of the last `window` rows."""
    close = F.col("close")
    low, high = min_n(close, window), max_n(close, window)
    width = high - low
    return bars.withColumn("Value_Factor", (close - low) / F.when(width == 0, 0.5).otherwise(width))
