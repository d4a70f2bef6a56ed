"""Technical indicators: one row in, one row out, rolling over each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.blocks import rolling
from tickloom.functions.rolling import lag, max_n, mean_n, ratio, std_n

MA_PERIODS = (5, 20, 50, 200)


def _c(name: str) -> Column:
    return F.col(name)


@rolling(lookback=1)
def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("returns", ratio(_c("close"), lag(_c("close"))) - 1)


@rolling(lookback=lambda p: max(p["periods"]))
def moving_averages(bars: DataFrame, periods=MA_PERIODS) -> DataFrame:
    return bars.withColumns({f"MA_{n}": mean_n(_c("close"), n) for n in periods})


@rolling(lookback=lambda p: max(p["periods"]))
def ma_ratios(bars: DataFrame, periods=MA_PERIODS) -> DataFrame:
    return bars.withColumns({f"MA_Ratio_{n}": ratio(_c("close"), mean_n(_c("close"), n)) for n in periods})


@rolling(lookback=lambda p: p["period"] + 1)
def rsi(bars: DataFrame, period: int = 14, first_counts: bool = True) -> DataFrame:
    """Relative strength on simple means.

    The unknown difference of the first row counts as zero unless
    `first_counts` is false, which delays the first value by one row.
    """
    move = _c("close") - lag(_c("close"))
    if first_counts:
        move = F.coalesce(move, F.lit(0.0))
    moved = bars.withColumns({
        "_gain": F.when(move > 0, move).when(move <= 0, 0.0),
        "_loss": F.when(move < 0, -move).when(move >= 0, 0.0),
    })
    gain, loss = mean_n(_c("_gain"), period), mean_n(_c("_loss"), period)
    return moved.withColumn("RSI", 100 * ratio(gain, gain + loss)).drop("_gain", "_loss")


@rolling(lookback=lambda p: p["period"])
def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    bands = bars.withColumns({"BB_Mid": mean_n(_c("close"), period), "_std": std_n(_c("close"), period)})
    bands = bands.withColumns({
        "BB_Upper": _c("BB_Mid") + width * _c("_std"),
        "BB_Lower": _c("BB_Mid") - width * _c("_std"),
    })
    span = _c("BB_Upper") - _c("BB_Lower")
    return bands.withColumns({
        "BB_Width": ratio(span, _c("BB_Mid")),
        "BB_PercentB": ratio(_c("close") - _c("BB_Lower"), span),
    }).drop("_std")


@rolling(lookback=lambda p: p["period"] + 1)
def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Average true range; `greatest` skips the unknown previous close of row 1."""
    before = lag(_c("close"))
    true_range = F.greatest(
        _c("high") - _c("low"), F.abs(_c("high") - before), F.abs(_c("low") - before)
    )
    ranged = bars.withColumn("_tr", true_range)
    return ranged.withColumn("ATR", mean_n(_c("_tr"), period)).withColumn(
        "ATR_Ratio", ratio(_c("ATR"), _c("close"))
    ).drop("_tr")


@rolling(lookback=lambda p: p["period"] + 1)
def volatility(bars: DataFrame, period: int = 20) -> DataFrame:
    """Sample standard deviation of returns (adds `returns` when missing)."""
    if "returns" not in bars.columns:
        bars = returns(bars)
    return bars.withColumn(f"Volatility_{period}d", std_n(_c("returns"), period))


def _with_vol(bars: DataFrame) -> DataFrame:
    return bars if "Volatility_20d" in bars.columns else volatility(bars)


@rolling(lookback=lambda p: p["period"] + 21)
def volatility_ratio(bars: DataFrame, period: int = 252) -> DataFrame:
    bars = _with_vol(bars)
    return bars.withColumn("Volatility_Ratio", ratio(_c("Volatility_20d"), mean_n(_c("Volatility_20d"), period)))


@rolling(lookback=lambda p: p["period"])
def momentum(bars: DataFrame, period: int = 10) -> DataFrame:
    return bars.withColumn(f"Momentum_{period}d", _c("close") - lag(_c("close"), period))


@rolling(lookback=lambda p: p["period"])
def roc(bars: DataFrame, period: int = 10) -> DataFrame:
    return bars.withColumn(f"ROC_{period}d", ratio(_c("close"), lag(_c("close"), period)) - 1)


@rolling(lookback=lambda p: p["period"])
def volume_features(bars: DataFrame, period: int = 20) -> DataFrame:
    bars = bars.withColumn(f"Volume_MA_{period}d", mean_n(_c("volume"), period))
    return bars.withColumn("Volume_Ratio", ratio(_c("volume"), _c(f"Volume_MA_{period}d")))


@rolling(lookback=lambda p: p["period"] + 22)
def volatility_dynamics(bars: DataFrame, period: int = 5) -> DataFrame:
    """Slope and acceleration of the 20-day volatility."""
    bars = _with_vol(bars)
    vol = _c("Volatility_20d")
    bars = bars.withColumn("_step", vol - lag(vol))
    return bars.withColumns({
        f"Volatility_Slope_{period}d": vol - lag(vol, period),
        f"Volatility_Acceleration_{period}d": _c("_step") - lag(_c("_step"), period),
    }).drop("_step")


@rolling(lookback=lambda p: p["period"] + 20)
def range_changes(bars: DataFrame, period: int = 5) -> DataFrame:
    """Change of the ATR ratio and of the Bollinger width over `period` rows."""
    if "ATR_Ratio" not in bars.columns:
        bars = atr(bars)
    if "BB_Width" not in bars.columns:
        bars = bollinger(bars)
    return bars.withColumns({
        f"ATR_Ratio_Change_{period}d": _c("ATR_Ratio") - lag(_c("ATR_Ratio"), period),
        f"BB_Width_Change_{period}d": _c("BB_Width") - lag(_c("BB_Width"), period),
    })


@rolling(lookback=lambda p: p["period"])
def drawdown(bars: DataFrame, period: int = 20) -> DataFrame:
    return bars.withColumn(f"Drawdown_{period}d", ratio(_c("close"), max_n(_c("close"), period)) - 1)


@rolling(lookback=lambda p: p["period"] + 1)
def return_shock(bars: DataFrame, period: int = 5) -> DataFrame:
    if "returns" not in bars.columns:
        bars = returns(bars)
    return bars.withColumn(f"Return_Shock_{period}d", max_n(F.abs(_c("returns")), period))


@rolling(lookback=51)
def holdout_features(bars: DataFrame) -> DataFrame:
    """The smaller feature set used by the fixed-date holdout study."""
    bars = returns(bars)
    bars = rsi(ma_ratios(bars, periods=(20, 50)), first_counts=False)
    bars = atr(bollinger(bars))
    bars = volume_features(roc(momentum(bars)))
    return bars.withColumns({
        "BB_Position": _c("BB_PercentB"),
        "Momentum_10": _c("Momentum_10d"),
        "ROC_10": _c("ROC_10d"),
        "Volatility_20": std_n(_c("returns"), 20),
        "Volatility_50": std_n(_c("returns"), 50),
    })


HOLDOUT_COLUMNS = [
    "MA_Ratio_20", "MA_Ratio_50", "RSI", "BB_Position", "ATR", "Momentum_10", "ROC_10",
    "Volume_Ratio", "Volatility_20", "Volatility_50",
]
