"""Liquidity and transaction-cost proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.blocks import rolling
from tickloom.functions.rolling import mean_n
from tickloom.operators.regime import with_volatility
from tickloom.operators.technical import returns as add_returns


def _or_one(value: Column) -> Column:
    return F.when(value == 0, 1.0).otherwise(value)


@rolling(lookback=lambda p: max(p["period"], 20) + 21)
def liquidity(bars: DataFrame, period: int = 20) -> DataFrame:
    """Average volume, relative volume, Amihud ratio, spread proxy and impact."""
    if "returns" not in bars.columns:
        bars = add_returns(bars)
    bars = with_volatility(bars)
    close, volume = F.col("close"), F.col("volume")
    bars = bars.withColumns({
        f"LQ_ADV_{period}d": mean_n(volume, period),
        "_illiq": F.abs("returns") / _or_one(volume * close),
    })
    relative = volume / _or_one(F.col(f"LQ_ADV_{period}d"))
    return bars.withColumns({
        "LQ_RelVol": relative,
        f"LQ_Amihud_{period}d": mean_n(F.col("_illiq"), period),
        "LQ_Spread_Proxy": (F.col("high") - F.col("low")) / _or_one(close),
        "LQ_Impact_Estimate": F.coalesce(F.sqrt(relative) * F.col("Volatility_20d"), F.lit(0.0)),
    }).drop("_illiq")
