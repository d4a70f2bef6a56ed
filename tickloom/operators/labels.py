"""Volatility-event labels.  1, 0 or NULL when the answer is not known yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.blocks import rolling
from tickloom.functions.rolling import full, lag, last_n, lead, series
from tickloom.operators.regime import quantile_name, volatility_quantiles, with_volatility

_LOOKBACK = 252 + 22


def _threshold(bars: DataFrame, percentile: float, window: int):
    bars = volatility_quantiles(bars, (percentile,), window)
    return bars.withColumn("_threshold", F.col(quantile_name(percentile, window)))


def _tidy(bars: DataFrame, given: list[str]) -> DataFrame:
    return bars.drop(*[c for c in bars.columns if c.startswith("_") and c not in given])


@rolling(lookback=_LOOKBACK, lookahead=lambda p: p["horizon"])
def spike_target(bars: DataFrame, horizon: int = 1, percentile: float = 0.75, window: int = 252) -> DataFrame:
    """Volatility `horizon` rows ahead exceeds today's rolling threshold."""
    given = bars.columns
    bars = _threshold(bars, percentile, window)
    ahead = lead(F.col("Volatility_20d"), horizon)
    return _tidy(bars.withColumn("spike", (ahead > F.col("_threshold")).cast("int")), given)


@rolling(lookback=_LOOKBACK, lookahead=lambda p: p["horizon"])
def transition_target(bars: DataFrame, horizon: int = 1, percentile: float = 0.75, window: int = 252) -> DataFrame:
    """Not in the high-volatility state today, in it `horizon` rows ahead."""
    given = bars.columns
    bars = _threshold(bars, percentile, window)
    bars = bars.withColumn("_high", F.coalesce(F.col("Volatility_20d") > F.col("_threshold"), F.lit(False)))
    bars = bars.withColumn("_high_ahead", lead(F.col("_high"), horizon))
    known = F.col("_high_ahead").isNotNull() & F.col("_threshold").isNotNull()
    label = F.when(known, (~F.col("_high") & F.col("_high_ahead")).cast("int"))
    return _tidy(bars.withColumn("transition", label), given)


@rolling(lookback=_LOOKBACK, lookahead=lambda p: max(p["horizons"]))
def transition_targets(bars: DataFrame, horizons: tuple[int, ...] = (1, 5), percentile: float = 0.75, window: int = 252) -> DataFrame:
    """`transition_target` for several horizons over one layout, as `transition_<horizon>`."""
    given = bars.columns
    bars = _threshold(bars, percentile, window)
    bars = bars.withColumn("_high", F.coalesce(F.col("Volatility_20d") > F.col("_threshold"), F.lit(False)))
    bars = bars.withColumns({f"_ahead_{h}": lead(F.col("_high"), h) for h in horizons})
    known = F.col("_threshold").isNotNull()
    targets = {f"transition_{h}": F.when(known & F.col(f"_ahead_{h}").isNotNull(), (~F.col("_high") & F.col(f"_ahead_{h}")).cast("int")) for h in horizons}
    return _tidy(bars.withColumns(targets), given)


def stack_horizons(rows: DataFrame, horizons: tuple[int, ...] = (1, 5), out: str = "label") -> DataFrame:
    """One row per known label: `horizon` and its label in place of the columns of `transition_targets`."""
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"transition_{h}").alias(out)) for h in horizons])
    names = [f"transition_{h}" for h in horizons]
    return rows.withColumn("_h", F.explode(each)).filter(F.col(f"_h.{out}").isNotNull()).select(*[c for c in rows.columns if c not in names], "_h.horizon", f"_h.{out}")


@rolling(lookback=lambda p: p["window"] + 22, lookahead=lambda p: p["horizon"])
def sigma_breakout(bars: DataFrame, window: int = 20, k: float = 1.5, horizon: int = 0) -> DataFrame:
    """Volatility crosses above its rolling mean plus k deviations.

    horizon 0 labels the row on which the crossing happens, h > 0 the row h
    rows before it.
    """
    given = bars.columns
    bars = with_volatility(bars)
    vol, w = F.col("Volatility_20d"), last_n(window)
    limit = full(vol, w, window, F.avg(vol).over(w) + k * F.stddev_samp(vol).over(w))
    bars = bars.withColumn("_threshold", limit)
    crossed = (vol > F.col("_threshold")) & (lag(vol) <= F.col("_threshold"))
    bars = bars.withColumn("_crossed", F.coalesce(crossed, F.lit(False)).cast("int"))
    ahead = F.col("_crossed") if horizon == 0 else lead(F.col("_crossed"), horizon)
    return _tidy(bars.withColumn("breakout", ahead), given)


@rolling(lookback=_LOOKBACK + 1)
def current_state(bars: DataFrame, percentile: float = 0.75, window: int = 252) -> DataFrame:
    """Whether today is in the high state, and whether it entered it today."""
    given = bars.columns
    bars = _threshold(bars, percentile, window)
    high = F.coalesce(F.col("Volatility_20d") > F.col("_threshold"), F.lit(False)).cast("int")
    bars = bars.withColumn("current_spike", high)
    rise = F.col("current_spike") - F.lag("current_spike").over(series())
    entered = F.coalesce(F.greatest(rise, F.lit(0)), F.lit(0))
    return _tidy(bars.withColumn("current_transition", entered), given)


def label_distribution(labelled: DataFrame, label: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Known labels, positives and positive rate."""
    known = labelled.filter(F.col(label).isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias("known"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )
