"""Realised-volatility estimators and intraday features.

Estimators work per (symbol, day): a frame is one trading day, whose number of
bars is fixed by the bar length, so windows inside it are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import small
from tickloom.functions.blocks import rolling
from tickloom.functions.prefix import running
from tickloom.functions.rolling import full, lag, last_n, ratio

DAY = ["symbol", "day"]
INTRADAY_WINDOWS = {"Intraday_Vol_1h": 12, "Intraday_Vol_4h": 48, "Intraday_Vol_1d": 288}


def _log(top: str, bottom: Column) -> Column:
    return F.ln(ratio(F.col(top), bottom))


def estimators(bars: DataFrame, periods_per_year: float = 252 * 78, range_periods: float = 252, published_rs: bool = True) -> DataFrame:
    """Close-to-close, Parkinson, Rogers-Satchell and fixed-weight Yang-Zhang per day.

    `published_rs` takes the published Rogers-Satchell term; otherwise half the
    sum of squared differences of ln(C/O), ln(H/C) and ln(C/L) is used.
    """
    day = bars.withColumn("day", F.to_date("bar_start"))
    in_day = Window.partitionBy(*DAY).orderBy("bar_start")
    day = day.withColumn("_prev", F.lag("close").over(in_day))
    co, ch, cl = _log("close", F.col("open")), _log("high", F.col("close")), _log("close", F.col("low"))
    if published_rs:
        term = ch * _log("high", F.col("open")) + cl * _log("open", F.col("low"))
    else:
        term = (F.pow(co - ch, 2) + F.pow(ch - cl, 2) + F.pow(cl - co, 2)) / 2
    rows = day.select(
        *DAY, _log("close", F.col("_prev")).alias("r"), _log("open", F.col("_prev")).alias("gap"),
        F.pow(_log("high", F.col("low")), 2).alias("hl"), term.alias("rs"),
    )
    n = F.count("*")
    zero = F.lit(0.0)
    return rows.groupBy(*DAY).agg(
        F.coalesce(F.stddev_samp("r") * math.sqrt(periods_per_year), zero).alias("close_to_close_vol"),
        F.when(n >= 2, F.sqrt(F.sum("hl") / (n * 4 * math.log(2))) * math.sqrt(range_periods)).otherwise(zero).alias("parkinson_vol"),
        F.when(F.count("rs") >= 2, F.sqrt(F.avg("rs")) * math.sqrt(range_periods)).otherwise(zero).alias("rogers_satchell_vol"),
        (
            F.sqrt(0.34 * F.pow(F.stddev_samp("gap"), 2) + 0.33 * F.avg("rs") + 0.33 * F.pow(F.stddev_samp("r"), 2))
            * math.sqrt(range_periods)
        ).alias("yang_zhang_vol"),
    )


_TYPICAL = "(high + low + close) / 3"


def vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price per day."""
    day = bars.select("symbol", F.to_date("bar_start").alias("day"), (F.expr(_TYPICAL) * F.col("volume")).alias("pv"), "volume")
    return day.groupBy(*DAY).agg(F.try_divide(F.sum("pv"), F.sum("volume")).alias("VWAP"))


def cumulative_vwap(bars: DataFrame) -> DataFrame:
    """VWAP of everything up to each bar; the last row is the VWAP of the series."""
    summed = running(
        bars, ["symbol"], F.to_date("bar_start"), [F.col("bar_start")],
        sums={"_pv": F.expr(_TYPICAL) * F.col("volume"), "_v": F.col("volume")},
    )
    return summed.withColumn("VWAP", F.try_divide("_pv", "_v")).drop("_pv", "_v")


def volume_weighted_return(bars: DataFrame) -> DataFrame:
    """Bar return scaled by volume over the symbol's mean volume."""
    mean = bars.groupBy("symbol").agg(F.avg("volume").alias("_mean"))
    move = ratio(F.col("close") - F.col("open"), F.col("open"))
    return bars.join(small(mean), "symbol").withColumn(
        "Volume_Weighted_Return", ratio(move * F.col("volume"), F.col("_mean"))
    ).drop("_mean")


@rolling(lookback=289, order="bar_start")
def intraday_vol(bars: DataFrame, periods_per_year: float = 252 * 78) -> DataFrame:
    bars = bars.withColumn("_r", _log("close", lag(F.col("close"), 1, "bar_start")))
    out = {}
    for name, n in INTRADAY_WINDOWS.items():
        w = last_n(n, "bar_start")
        out[name] = full(F.col("_r"), w, n, F.stddev_samp("_r").over(w) * math.sqrt(periods_per_year))
    return bars.withColumns(out).drop("_r")


def intraday_features(bars: DataFrame, periods_per_year: float = 252 * 78) -> DataFrame:
    return volume_weighted_return(cumulative_vwap(intraday_vol(bars, periods_per_year)))


def daily_resample(features: DataFrame) -> DataFrame:
    """Last value of the day for levels, sum for the volume-weighted return."""
    levels = ["VWAP", *INTRADAY_WINDOWS]
    return features.withColumn("day", F.to_date("bar_start")).groupBy(*DAY).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_start"))).alias(c) for c in levels],
        F.sum("Volume_Weighted_Return").alias("Volume_Weighted_Return"),
    )


def add_tick_features(daily: DataFrame, resampled: DataFrame) -> DataFrame:
    """Attach the daily values as Tick_* columns; days without ticks stay NULL."""
    renamed = resampled.withColumnRenamed("day", "bar_date").withColumnsRenamed(
        {c: f"Tick_{c}" for c in ("VWAP", *INTRADAY_WINDOWS, "Volume_Weighted_Return")}
    )
    return daily.join(renamed, ["symbol", "bar_date"], "left")
