"""Queries over daily bars: sources, quality, cleaning, windows, labels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tickloom.operators import cleaning, factors, labels, liquidity, quality, regime, reversion
from tickloom.operators import technical as ta
from tickloom.plans import views
from tickloom.plans.registry import query, rounded, rounded_sql
from tickloom.sources import bars as src

W = "(PARTITION BY symbol ORDER BY bar_date"


def _full(agg: str, col: str, n: int) -> str:
    frame_ = f"{W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) OVER {frame_} >= {n} THEN {agg} OVER {frame_} END"


def _lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER {W})"


def window_query(name: str, op, columns: dict[str, tuple[str, int]], ctes: str = views.BARS_SQL, source: str = "bars", extra: str = ""):
    """Register a rolling operator on the daily bars with its SQL twin."""
    digits = {c: d for c, (_, d) in columns.items()}

    @query(name, f"WITH {ctes}{extra} {rounded_sql(columns, source)}")
    def run(spark, sf):
        return rounded(op(views.bars_daily(spark, sf)), digits)


# --- A sources ---------------------------------------------------------------

_BAR_DIGITS = {"open": 4, "high": 4, "low": 4, "close": 4, "volume": 4}
_BAR_COLS = {c: (c, 4) for c in _BAR_DIGITS}


@query(
    "load_bars_range",
    f"WITH {views.BARS_SQL} {rounded_sql(_BAR_COLS, 'bars')} "
    "WHERE symbol IN ('AF', 'RF') AND bar_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
)
def load_bars_range(spark, sf):
    chosen = src.select_bars(views.bars_daily(spark, sf), ["AF", "RF"], "1996-01-01", "1997-12-31")
    return rounded(chosen, _BAR_DIGITS)


@query("load_multi_symbol", f"WITH {views.BARS_SQL} SELECT symbol, count(*) AS n_bars, min(bar_date) AS first_date, max(bar_date) AS last_date FROM bars GROUP BY 1")
def load_multi_symbol(spark, sf):
    return views.bars_daily(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date")
    )


@query(
    "normalize_columns",
    f"WITH {views.BARS_SQL}, dates AS (SELECT DISTINCT bar_date FROM bars), syms AS (SELECT * FROM (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) v(symbol)) "
    "SELECT s.symbol, d.bar_date, round(b.open, 4) + 0.0 AS open, round(b.high, 4) + 0.0 AS high, round(b.low, 4) + 0.0 AS low, "
    "round(b.close, 4) + 0.0 AS close, round(b.volume, 4) + 0.0 AS volume "
    "FROM dates d CROSS JOIN syms s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_date = d.bar_date",
)
def normalize_columns(spark, sf):
    wide = views.bars_daily(spark, sf).groupBy(F.col("bar_date").alias("Date")).agg(*[
        F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{c.capitalize()}|{s}")
        for s in ("AF", "AO", "NF", "NO", "RF", "RO") for c in _BAR_DIGITS
    ])
    return rounded(src.normalize_columns(wide), _BAR_DIGITS)


# --- B quality ---------------------------------------------------------------

_D = views.DIRTY_SQL


@query("quality_row_count", f"WITH {_D} SELECT symbol, count(*) AS rows, count(*) < 1000 AS too_few FROM dirty GROUP BY 1")
def quality_row_count(spark, sf):
    return quality.row_counts(views.dirty_bars(spark, sf))


@query(
    "quality_order",
    "WITH o AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS bar_date, "
    "lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders) "
    "SELECT symbol, CAST(count(*) FILTER (WHERE bar_date < before) AS BIGINT) AS out_of_order FROM o GROUP BY 1",
)
def quality_order(spark, sf):
    arrived = views.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("bar_date"), "o_orderkey"
    )
    return quality.out_of_order(arrived, "o_orderkey")


@query(
    "quality_required_columns",
    f"WITH {_D} SELECT symbol, c AS column_name, c <> 'open' AS present, CASE WHEN c <> 'open' THEN count(*) ELSE 0 END AS rows "
    "FROM dirty, (VALUES ('open'), ('high'), ('low'), ('close'), ('volume')) v(c) GROUP BY 1, 2",
)
def quality_required_columns(spark, sf):
    """A table without opening prices."""
    return quality.column_report(views.dirty_bars(spark, sf).drop("open"))


@query("quality_duplicates", f"WITH {_D} SELECT symbol, CAST(count(*) - count(DISTINCT bar_date) AS BIGINT) AS duplicates FROM dirty GROUP BY 1")
def quality_duplicates(spark, sf):
    return quality.duplicate_dates(views.dirty_bars(spark, sf))


_NULLS = "sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT)"


@query(
    "quality_missing",
    f"WITH {_D} SELECT symbol, CAST({_NULLS} AS BIGINT) AS missing, round({_NULLS}::DOUBLE / (count(*) * 5), 8) + 0.0 AS missing_fraction FROM dirty GROUP BY 1",
)
def quality_missing(spark, sf):
    return rounded(quality.missing_fraction(views.dirty_bars(spark, sf)), {"missing_fraction": 8}, ("symbol", "missing"))


@query(
    "quality_values",
    f"WITH {_D} SELECT symbol, count(*) FILTER (WHERE close <= 0) AS nonpositive_close, count(*) FILTER (WHERE high < low) AS inverted FROM dirty GROUP BY 1",
)
def quality_values(spark, sf):
    return quality.value_checks(views.dirty_bars(spark, sf))


_MOVES = """, moved AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar_date), 0) - 1 AS returns FROM dirty)"""


@query("quality_extreme_moves", f"WITH {_D}{_MOVES} SELECT symbol, count(*) FILTER (WHERE abs(returns) > 0.3) AS extreme_moves FROM moved GROUP BY 1")
def quality_extreme_moves(spark, sf):
    return quality.extreme_moves(views.dirty_bars(spark, sf))


_REPORT = f"""{_D}{_MOVES},
stats AS (
  SELECT symbol, count(*)::DOUBLE AS rows, {_NULLS}::DOUBLE / (count(*) * 5) AS missing_fraction,
         (count(*) FILTER (WHERE close <= 0))::DOUBLE AS nonpositive_close,
         (count(*) FILTER (WHERE high < low))::DOUBLE AS inverted,
         (count(*) FILTER (WHERE abs(returns) > 0.3))::DOUBLE AS extreme_moves,
         (count(*) - count(DISTINCT bar_date))::DOUBLE AS duplicates, 0.0::DOUBLE AS missing_columns
  FROM moved GROUP BY 1),
report AS (
  SELECT symbol, "check", round(value, 8) + 0.0 AS value,
         CASE WHEN ("check" = 'rows' AND value < 1000) OR ("check" = 'missing_fraction' AND value > 0.05)
                OR ("check" IN ('nonpositive_close', 'duplicates', 'missing_columns') AND value > 0) THEN 'error'
              WHEN "check" IN ('missing_fraction', 'inverted', 'extreme_moves') AND value > 0 THEN 'warning'
              ELSE 'ok' END AS level
  FROM (UNPIVOT stats ON rows, missing_fraction, nonpositive_close, inverted, extreme_moves, duplicates, missing_columns INTO NAME "check" VALUE value) u)
"""


@query("quality_report", f'WITH {_REPORT} SELECT symbol, "check", value, level FROM report')
def quality_report(spark, sf):
    return rounded(quality.validation_report(views.dirty_bars(spark, sf)), {"value": 8}, ("symbol", "check", "level"))


@query(
    "quality_verdict",
    f"WITH {_REPORT} SELECT symbol, CASE WHEN bool_or(level = 'error') THEN 'error' WHEN bool_or(level = 'warning') THEN 'warning' ELSE 'ok' END AS worst, "
    "NOT bool_or(level = 'error') AS passed FROM report GROUP BY 1",
)
def quality_verdict(spark, sf):
    return quality.verdict(quality.validation_report(views.dirty_bars(spark, sf)))


# --- C cleaning ----------------------------------------------------------------

_FIVE = {c: (c, 4) for c in ("open", "high", "low", "close", "volume")}


@query("clean_high_low", f"WITH {_D} SELECT symbol, bar_date, round(greatest(high, low), 4) + 0.0 AS high, round(least(high, low), 4) + 0.0 AS low FROM dirty")
def clean_high_low(spark, sf):
    return rounded(cleaning.fix_high_low(views.dirty_bars(spark, sf)), {"high": 4, "low": 4})


_FILL = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _FIVE)


@query(
    "clean_forward_fill",
    f"WITH {_D} SELECT symbol, bar_date, round(close, 4) + 0.0 AS close, round(volume, 4) + 0.0 AS volume FROM "
    f"(SELECT symbol, bar_date, {_FILL} FROM dirty WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)) t",
)
def clean_forward_fill(spark, sf):
    return rounded(cleaning.forward_fill(views.dirty_bars(spark, sf)), {"close": 4, "volume": 4})


@query("clean_drop_incomplete", f"WITH {_D} {rounded_sql(_FIVE, 'dirty')} WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL")
def clean_drop_incomplete(spark, sf):
    return rounded(cleaning.drop_incomplete(views.dirty_bars(spark, sf)), _BAR_DIGITS)


_AS_TEXT = "CASE WHEN rn % 71 = 0 THEN 'n/a' ELSE CAST(close AS VARCHAR) END"


@query("clean_coerce_numeric", f"WITH {_D} SELECT symbol, bar_date, round(TRY_CAST({_AS_TEXT} AS DOUBLE), 4) + 0.0 AS close FROM dirty")
def clean_coerce_numeric(spark, sf):
    text = views.dirty_bars(spark, sf).withColumn(
        "close", F.when(F.col("rn") % 71 == 0, "n/a").otherwise(F.col("close").cast("string"))
    )
    return rounded(cleaning.coerce_numeric(text, ["close"]), {"close": 4})


@query("clean_zero_volume", f"WITH {_D} {rounded_sql(_FIVE, 'dirty')} WHERE volume > 0")
def clean_zero_volume(spark, sf):
    return rounded(cleaning.drop_zero_volume(views.dirty_bars(spark, sf)), _BAR_DIGITS)


@query(
    "clean_bars",
    f"WITH {_D}, fixed AS (SELECT symbol, bar_date, open, greatest(high, low) AS high, least(high, low) AS low, close, volume FROM dirty), "
    f"filled AS (SELECT symbol, bar_date, {_FILL} FROM fixed WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)) "
    f"{rounded_sql(_FIVE, 'filled')} WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume > 0",
)
def clean_bars(spark, sf):
    return rounded(cleaning.clean(views.dirty_bars(spark, sf)), _BAR_DIGITS)


# --- D technical -----------------------------------------------------------------

_VOL = views.VOL_SQL

window_query("returns", ta.returns, {"returns": ("returns", 6)}, _VOL, "ret")
window_query("moving_averages", ta.moving_averages, {f"MA_{n}": (_full("avg(close)", "close", n), 6) for n in ta.MA_PERIODS})
window_query("ma_ratios", ta.ma_ratios, {f"MA_Ratio_{n}": (f"close / ({_full('avg(close)', 'close', n)})", 6) for n in ta.MA_PERIODS})

_MOVE = f""",
move AS (SELECT *, close - {_lag('close')} AS move FROM bars),
gl AS (SELECT *, CASE WHEN move > 0 THEN move ELSE 0.0 END AS gain, CASE WHEN move < 0 THEN -move ELSE 0.0 END AS loss FROM move),
mgl AS (SELECT *, {_full('avg(gain)', 'gain', 14)} AS g, {_full('avg(loss)', 'loss', 14)} AS l FROM gl)"""
window_query("rsi", ta.rsi, {"RSI": ("100 * g / nullif(g + l, 0)", 6)}, extra=_MOVE, source="mgl")

_BB = f""",
bb AS (SELECT *, {_full('avg(close)', 'close', 20)} AS m, {_full('stddev_samp(close)', 'close', 20)} AS s FROM bars)"""
window_query("bollinger", ta.bollinger, {
    "BB_Mid": ("m", 4), "BB_Upper": ("m + 2 * s", 4), "BB_Lower": ("m - 2 * s", 4),
    "BB_Width": ("(m + 2 * s - (m - 2 * s)) / nullif(m, 0)", 6),
    "BB_PercentB": ("(close - (m - 2 * s)) / nullif(m + 2 * s - (m - 2 * s), 0)", 6),
}, extra=_BB, source="bb")

_TR = f""",
tr AS (SELECT *, greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) AS tr FROM bars),
atr AS (SELECT *, {_full('avg(tr)', 'tr', 14)} AS atr FROM tr)"""
window_query("atr", ta.atr, {"ATR": ("atr", 4), "ATR_Ratio": ("atr / nullif(close, 0)", 6)}, extra=_TR, source="atr")

window_query("volatility", ta.volatility, {"Volatility_20d": ("vol", 6)}, _VOL, "vol")
window_query("volatility_ratio", ta.volatility_ratio, {"Volatility_Ratio": (f"vol / nullif({_full('avg(vol)', 'vol', 252)}, 0)", 6)}, _VOL, "vol")
window_query("momentum", ta.momentum, {"Momentum_10d": (f"close - {_lag('close', 10)}", 4)})
window_query("rate_of_change", ta.roc, {"ROC_10d": (f"close / nullif({_lag('close', 10)}, 0) - 1", 6)})
window_query("volume_features", ta.volume_features, {
    "Volume_MA_20d": (_full("avg(volume)", "volume", 20), 4),
    "Volume_Ratio": (f"volume / nullif({_full('avg(volume)', 'volume', 20)}, 0)", 6),
})
_STEP = f", step AS (SELECT *, vol - {_lag('vol')} AS step FROM vol)"
window_query("volatility_slope", ta.volatility_dynamics, {"Volatility_Slope_5d": (f"vol - {_lag('vol', 5)}", 6)}, _VOL, "vol")
window_query("volatility_acceleration", ta.volatility_dynamics, {"Volatility_Acceleration_5d": (f"step - {_lag('step', 5)}", 6)}, _VOL, "step", _STEP)
window_query("range_changes", ta.range_changes, {
    "ATR_Ratio_Change_5d": (f"r - {_lag('r', 5)}", 6), "BB_Width_Change_5d": (f"w - {_lag('w', 5)}", 6),
}, views.BARS_SQL, "rc", _TR + f""",
rc AS (SELECT *, atr / nullif(close, 0) AS r, 4 * {_full('stddev_samp(close)', 'close', 20).replace('CASE', '(CASE')}) / ({_full('avg(close)', 'close', 20)}) AS w FROM atr)""")
window_query("drawdown_20d", ta.drawdown, {"Drawdown_20d": (f"close / nullif({_full('max(close)', 'close', 20)}, 0) - 1", 6)})
window_query("return_shock", ta.return_shock, {"Return_Shock_5d": (_full("max(abs(returns))", "returns", 5), 6)}, _VOL, "ret")

_HOLD = f""",
hm AS (SELECT *, close - {_lag('close')} AS move FROM ret),
hg AS (SELECT *, CASE WHEN move > 0 THEN move WHEN move <= 0 THEN 0.0 END AS gain, CASE WHEN move < 0 THEN -move WHEN move >= 0 THEN 0.0 END AS loss,
       greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) AS tr,
       {_full('avg(close)', 'close', 20)} AS m20, {_full('stddev_samp(close)', 'close', 20)} AS s20 FROM hm),
hold AS (SELECT *, {_full('avg(gain)', 'gain', 14)} AS g, {_full('avg(loss)', 'loss', 14)} AS l FROM hg)"""
window_query("holdout_features", ta.holdout_features, {
    "MA_Ratio_20": ("close / m20", 6), "MA_Ratio_50": (f"close / ({_full('avg(close)', 'close', 50)})", 6),
    "RSI": ("100 * g / nullif(g + l, 0)", 6), "BB_Position": ("(close - (m20 - 2 * s20)) / nullif(4 * s20, 0)", 6),
    "ATR": (_full("avg(tr)", "tr", 14), 4), "Momentum_10": (f"close - {_lag('close', 10)}", 4),
    "ROC_10": (f"close / nullif({_lag('close', 10)}, 0) - 1", 6),
    "Volume_Ratio": (f"volume / nullif({_full('avg(volume)', 'volume', 20)}, 0)", 6),
    "Volatility_20": (_full("stddev_samp(returns)", "returns", 20), 6),
    "Volatility_50": (_full("stddev_samp(returns)", "returns", 50), 6),
}, _VOL, "hold", _HOLD)

# --- E regimes -------------------------------------------------------------------

_REGIME = views.VOL_SQL + views.thresholds_sql(0.33, 0.67) + """,
reg AS (SELECT *, CASE WHEN vol < q33 THEN 1 WHEN vol > q67 THEN 3 ELSE 2 END AS regime FROM thr)
"""
_INT = "SELECT symbol, bar_date, CAST({} AS INTEGER) AS {} FROM {}"


@query("volatility_regime", f"WITH {_REGIME} {_INT.format('regime', 'Vol_Regime', 'reg')}")
def volatility_regime(spark, sf):
    return regime.volatility_regime(views.bars_daily(spark, sf)).select("symbol", "bar_date", "Vol_Regime")


_TREND = f"coalesce(close > ({_full('avg(close)', 'close', 50)}), false)"


@query("trend_regime", f"WITH {views.BARS_SQL} {_INT.format(_TREND, 'Trend_Regime', 'bars')}")
def trend_regime(spark, sf):
    return regime.trend_regime(views.bars_daily(spark, sf)).select("symbol", "bar_date", "Trend_Regime")


def _stay(state: int) -> str:
    return (
        f"CASE WHEN rn > 252 THEN sum(CASE WHEN regime = {state} AND before = {state} THEN 1.0 ELSE 0.0 END) OVER {W} ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)"
        f" / greatest(sum(CASE WHEN regime = {state} THEN 1.0 ELSE 0.0 END) OVER {W} ROWS BETWEEN 252 PRECEDING AND 2 PRECEDING), 1.0) END"
    )


_BEFORE = f", rb AS (SELECT *, {_lag('regime')} AS before FROM reg)"
window_query("regime_transitions", regime.regime_transitions, {
    "RP_LowToLow_Prob": (_stay(1), 6), "RP_HighToHigh_Prob": (_stay(3), 6),
}, _REGIME, "rb", _BEFORE)


@query(
    "regime_duration",
    f"WITH {_REGIME}{_BEFORE}, isl AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> regime THEN 1 ELSE 0 END) OVER {W}) AS run FROM rb) "
    "SELECT symbol, bar_date, row_number() OVER (PARTITION BY symbol, run ORDER BY bar_date) AS RP_Duration_Days FROM isl",
)
def regime_duration(spark, sf):
    return regime.regime_duration(views.bars_daily(spark, sf)).select("symbol", "bar_date", "RP_Duration_Days")


_W60 = f"{W} ROWS 59 PRECEDING)"
_PAIR = ", pr AS (SELECT *, CASE WHEN vol IS NOT NULL THEN abs(returns) END AS ar FROM vol)"
window_query("return_vol_correlation", regime.return_vol_correlation, {
    "RP_ReturnVol_Corr_60d": (
        f"CASE WHEN count(ar) OVER {_W60} >= 60 THEN covar_samp(ar, vol) OVER {_W60} / nullif(stddev_samp(ar) OVER {_W60} * stddev_samp(vol) OVER {_W60}, 0) END", 6),
}, _VOL, "pr", _PAIR)

# --- F mean reversion ------------------------------------------------------------


def _z(n: int) -> str:
    s = _full("stddev_samp(close)", "close", n)
    return f"(close - ({_full('avg(close)', 'close', n)})) / (CASE WHEN ({s}) = 0 THEN 1.0 ELSE ({s}) END)"


window_query("zscore", reversion.zscore, {"MR_ZScore_20d": (_z(20), 6), "MR_ZScore_50d": (_z(50), 6)})
window_query("ou_spread", reversion.ou_spread, {"MR_OU_Spread_20d": (_z(20), 6)})

_LAGS = range(2, 50)
_HURST = (
    f", lagged AS (SELECT *, {', '.join(f'returns - {_lag('returns', k)} AS d{k}' for k in _LAGS)} FROM ret), "
    f"disp AS (SELECT *, count(returns) OVER {W} ROWS 99 PRECEDING) AS known, "
    + ", ".join(f"ln(nullif(stddev_pop(d{k}) OVER {W} ROWS {99 - k} PRECEDING), 0)) AS s{k}" for k in _LAGS)
    + " FROM lagged)"
)
_MEAN_LOG = "(" + " + ".join(f"ln({k})" for k in _LAGS) + ") / 48.0"
_SLOPE = (
    "2 * (" + " + ".join(f"s{k} * (ln({k}) - mean_log)" for k in _LAGS) + ") / ("
    + " + ".join(f"pow(ln({k}) - mean_log, 2)" for k in _LAGS) + ")"
)
window_query(
    "hurst", reversion.hurst, {"MR_Hurst_100d": (f"CASE WHEN known >= 100 THEN {_SLOPE} END", 6)}, _VOL, "hl",
    _HURST + f", hl AS (SELECT *, {_MEAN_LOG} AS mean_log FROM disp)",
)
_W49 = f"{W} ROWS 48 PRECEDING)"
window_query("half_life", reversion.half_life, {
    "MR_HalfLife_50d": ("CASE WHEN b < 0 AND b >= -2 THEN -ln(2) / b END", 5),
}, _VOL, "ar", f", pv AS (SELECT *, {_lag('returns')} AS prev FROM ret), ar AS (SELECT *, CASE WHEN count(prev) OVER {_W49} >= 49 THEN regr_slope(returns - prev, prev) OVER {_W49} END AS b FROM pv)")

# --- G liquidity -------------------------------------------------------------------

_ADV = f", adv AS (SELECT *, {_full('avg(volume)', 'volume', 20)} AS adv, abs(returns) / CASE WHEN volume * close = 0 THEN 1.0 ELSE volume * close END AS ill FROM vol)"
_REL = "volume / CASE WHEN adv = 0 THEN 1.0 ELSE adv END"
_LQ = {
    "LQ_ADV_20d": ("adv", 4), "LQ_RelVol": (_REL, 6),
    "LQ_Amihud_20d": (f"1e9 * ({_full('avg(ill)', 'ill', 20)})", 6),
    "LQ_Spread_Proxy": ("(high - low) / CASE WHEN close = 0 THEN 1.0 ELSE close END", 6),
    "LQ_Impact_Estimate": (f"coalesce(sqrt({_REL}) * vol, 0.0)", 6),
}


def _liquidity(bars):
    return liquidity.liquidity(bars).withColumn("LQ_Amihud_20d", F.col("LQ_Amihud_20d") * 1e9)


window_query("liquidity", _liquidity, _LQ, _VOL, "adv", _ADV)
for _name, _key in {
    "liquidity_adv": "LQ_ADV_20d", "liquidity_relative_volume": "LQ_RelVol", "liquidity_amihud": "LQ_Amihud_20d",
    "liquidity_spread_proxy": "LQ_Spread_Proxy", "liquidity_impact": "LQ_Impact_Estimate",
}.items():
    window_query(_name, _liquidity, {_key: _LQ[_key]}, _VOL, "adv", _ADV)

# --- H factors -----------------------------------------------------------------------

_MKT = ", mkt AS (SELECT bar_date, avg(returns) AS mr FROM ret GROUP BY 1), rm AS (SELECT r.*, mr FROM ret r LEFT JOIN mkt USING (bar_date)), kn AS (SELECT *, CASE WHEN returns IS NOT NULL AND mr IS NOT NULL THEN returns END AS y, CASE WHEN returns IS NOT NULL AND mr IS NOT NULL THEN mr END AS x FROM rm)"
_W60P = f"{W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_BETA = f", bt AS (SELECT *, CASE WHEN count(y) OVER {_W60P} >= 60 THEN regr_slope(y, x) OVER {_W60P} END AS beta, var_pop(y) OVER {_W60P} AS vy, var_pop(x) OVER {_W60P} AS vx FROM kn)"
window_query("market_beta", factors.market_beta, {"Market_Beta": ("beta", 6)}, _VOL, "bt", _MKT + _BETA)
window_query("residual_volatility", factors.market_beta, {
    "Residual_Vol": ("CASE WHEN beta IS NOT NULL THEN sqrt(greatest(vy - beta * beta * vx, 0.0)) END", 6)}, _VOL, "bt", _MKT + _BETA)
window_query("size_factor", factors.size_proxy, {
    "Size_Factor": ("CASE WHEN len(h) = 252 THEN (len(list_filter(h, lambda v: v < vol)) + (len(list_filter(h, lambda v: v = vol)) + 1) / 2.0) / 252 END", 6)},
    _VOL, "hist", f", hist AS (SELECT *, list(vol) FILTER (WHERE vol IS NOT NULL) OVER {W} ROWS 251 PRECEDING) AS h FROM vol)")
_W252 = f"{W} ROWS 251 PRECEDING)"
window_query("value_factor", factors.value_proxy, {
    "Value_Factor": (f"CASE WHEN count(close) OVER {_W252} >= 252 THEN (close - min(close) OVER {_W252}) / (CASE WHEN max(close) OVER {_W252} = min(close) OVER {_W252} THEN 0.5 ELSE max(close) OVER {_W252} - min(close) OVER {_W252} END) END", 6)})


# --- L labels -------------------------------------------------------------------------

_THR = views.VOL_SQL + views.thresholds_sql(0.75)
_LABEL_INT = "SELECT symbol, bar_date, CAST({} AS INTEGER) AS {} FROM {}"


def _label_query(name: str, op, column: str, expression: str, ctes: str, source: str):
    @query(name, f"WITH {ctes} {_LABEL_INT.format(expression, column, source)}")
    def run(spark, sf):
        return op(views.bars_daily(spark, sf)).select("symbol", "bar_date", column)


_label_query("spike_target", labels.spike_target, "spike",
             f"CASE WHEN q75 IS NOT NULL AND lead(vol) OVER {W}) IS NOT NULL THEN lead(vol) OVER {W}) > q75 END", _THR, "thr")
_label_query("transition_target", labels.transition_target, "transition", "label", views.LABEL_SQL, "lab")
_label_query("transition_target_5d", partial(labels.transition_target, horizon=5), "transition",
             f"CASE WHEN q75 IS NOT NULL AND lead(is_high, 5) OVER {W}) IS NOT NULL THEN NOT is_high AND lead(is_high, 5) OVER {W}) END",
             _THR + ", hi AS (SELECT *, coalesce(vol > q75, false) AS is_high FROM thr)", "hi")
_SIGMA = _VOL + f", lim AS (SELECT *, ({_full('avg(vol)', 'vol', 20)}) + 1.5 * ({_full('stddev_samp(vol)', 'vol', 20)}) AS lim, {_lag('vol')} AS pv FROM vol)"
_label_query("sigma_breakout", labels.sigma_breakout, "breakout", "coalesce(vol > lim AND pv <= lim, false)", _SIGMA, "lim")


@query(
    "current_state",
    f"WITH {_THR}, high AS (SELECT *, CAST(coalesce(vol > q75, false) AS INTEGER) AS s FROM thr) "
    f"SELECT symbol, bar_date, s AS current_spike, coalesce(greatest(s - {_lag('s')}, 0), 0) AS current_transition FROM high",
)
def current_state(spark, sf):
    return labels.current_state(views.bars_daily(spark, sf)).select("symbol", "bar_date", "current_spike", "current_transition")


@query(
    "transition_label_rate",
    f"WITH {views.LABEL_SQL} SELECT symbol, count(*) AS known, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) + 0.0 AS positive_rate FROM lab WHERE label IS NOT NULL GROUP BY 1",
)
def transition_label_rate(spark, sf):
    cleaned = cleaning.clean(views.bars_daily(spark, sf))
    dist = labels.label_distribution(labels.transition_target(cleaned), "transition")
    return rounded(dist, {"positive_rate": 6}, ("symbol", "known", "positives"))
