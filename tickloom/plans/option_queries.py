"""Queries over option chains and intraday bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.functions.pricing import greeks_sql, implied_vol_sql
from tickloom.operators import implied, intraday, options
from tickloom.plans import views
from tickloom.plans.registry import query, rounded
from tickloom.sources.bars import interval_bars
from tickloom.sources.chains import normalize_chain

_CHAIN = views.CHAIN_SQL
_KEY = ("symbol", "as_of", "expiration_date", "strike", "option_type")
_KEYS = ", ".join(_KEY)
_G = _CHAIN + """,
gi AS (SELECT *, spot AS s, strike AS k, date_diff('day', as_of, expiration_date) / 365.0::DOUBLE AS t, implied_volatility AS v, option_type = 'call' AS c FROM chain)
""" + greeks_sql("gi")

# --- Q pricing -----------------------------------------------------------------


def _greek_query(name: str, column: str, digits: int):
    @query(name, f"WITH {_G} SELECT {_KEYS}, round({column}, {digits}) + 0.0 AS {column} FROM g")
    def run(spark, sf):
        return rounded(options.chain_greeks(views.chain(spark, sf)), {column: digits}, _KEY)


_greek_query("bs_price", "price", 6)
for _g, _d in {"delta": 6, "gamma": 6, "vega": 6, "theta": 6, "rho": 6}.items():
    _greek_query(f"bs_{_g}", _g, _d)


@query("chain_greeks", f"WITH {_G} SELECT {_KEYS}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("price", *options.GREEKS)) + " FROM g")
def chain_greeks(spark, sf):
    return rounded(options.chain_greeks(views.chain(spark, sf)), {c: 6 for c in ("price", *options.GREEKS)}, _KEY)


@query("implied_vol", f"WITH {_G} SELECT {_KEYS}, round(implied_volatility, 4) + 0.0 AS bs_iv FROM g WHERE vega >= 0.01")
def implied_vol(spark, sf):
    """The root for a quote equal to the model price is the volatility it was priced with."""
    priced = options.chain_greeks(views.chain(spark, sf)).filter("vega >= 0.01")
    solved = options.with_implied_vol(priced, F.col("price"), years=options.years_to_expiry())
    return rounded(solved, {"bs_iv": 4}, _KEY)


_IV = f"WITH RECURSIVE {_G}, iq AS (SELECT {_KEYS}, s, k, t, c, price AS q FROM g)" + implied_vol_sql("iq")


@query("implied_vol_chain", f"{_IV} SELECT {_KEYS}, round(root, 4) + 0.0 AS bs_iv FROM iv")
def implied_vol_chain(spark, sf):
    """Every contract; NULL where the quote does not determine a volatility."""
    priced = options.chain_greeks(views.chain(spark, sf))
    solved = options.with_implied_vol(priced, F.col("price"), years=options.years_to_expiry())
    return rounded(solved, {"bs_iv": 4}, _KEY)


_ERR = _CHAIN + """,
vi AS (SELECT *, spot AS s, strike AS k, greatest(date_diff('day', as_of, expiration_date) / 365.0::DOUBLE, 0.001) AS t, implied_volatility AS v, option_type = 'call' AS c, (bid + ask) / 2 AS mid FROM chain)
""" + greeks_sql("vi") + ", er AS (SELECT *, abs(price - mid) / (mid + 1e-6) AS pe FROM g)"


@query(
    "validate_chain",
    f"WITH {_ERR} SELECT symbol, as_of, count(*) AS n_contracts, round(avg(pe), 6) + 0.0 AS avg_pricing_error_pct, "
    "round(avg(CASE WHEN pe <= 0.1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS within_tolerance_pct FROM er GROUP BY 1, 2",
)
def validate_chain(spark, sf):
    table = options.validate_chain(views.chain(spark, sf), solve_iv=False)
    return rounded(table, {"avg_pricing_error_pct": 6, "within_tolerance_pct": 6}, ("symbol", "as_of", "n_contracts"))


@query("validate_chain_report", f"WITH {_ERR} SELECT {_KEYS}, round(t, 4) + 0.0 AS \"T\", round(mid, 4) + 0.0 AS market_mid, round(price, 4) + 0.0 AS bs_price, round(pe, 6) + 0.0 AS pricing_error_pct, pe <= 0.1 AS within_tolerance FROM er")
def validate_chain_report(spark, sf):
    table = options.chain_errors(views.chain(spark, sf), solve_iv=False)
    return rounded(table, {"T": 4, "market_mid": 4, "bs_price": 4, "pricing_error_pct": 6}, (*_KEY, "within_tolerance"))


@query(
    "validate_chain_iv",
    f"WITH RECURSIVE {_ERR}, iq AS (SELECT symbol, as_of, pe, implied_volatility AS v, s, k, t, c, mid AS q FROM er)" + implied_vol_sql("iq")
    + " SELECT symbol, as_of, count(*) AS n_contracts, round(avg(pe), 6) + 0.0 AS avg_pricing_error_pct, round(avg(CASE WHEN pe <= 0.1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS within_tolerance_pct, "
    "round(avg(abs(root - v) / (v + 1e-6)), 4) + 0.0 AS avg_iv_error_pct FROM iv GROUP BY 1, 2",
)
def validate_chain_iv(spark, sf):
    """The full report with implied-volatility errors."""
    table = options.validate_chain(views.chain(spark, sf))
    return rounded(
        table, {"avg_pricing_error_pct": 6, "within_tolerance_pct": 6, "avg_iv_error_pct": 4}, ("symbol", "as_of", "n_contracts")
    )


# --- Q straddles -------------------------------------------------------------------


@query("nearest_expiry", f"WITH {_CHAIN} SELECT symbol, as_of, coalesce(min(expiration_date) FILTER (WHERE expiration_date >= as_of), max(expiration_date)) AS nearest_expiry FROM chain GROUP BY 1, 2")
def nearest_expiry(spark, sf):
    return options.nearest_expiry(views.chain(spark, sf))


_PAIRS = """,
pairs AS MATERIALIZED (
  SELECT symbol, as_of, expiration_date, strike, min(bid) FILTER (WHERE option_type = 'call') AS cb, min(bid) FILTER (WHERE option_type = 'put') AS pb,
         min(ask) FILTER (WHERE option_type = 'call') AS ca, min(ask) FILTER (WHERE option_type = 'put') AS pa
  FROM chain GROUP BY 1, 2, 3, 4),
atm AS (
  SELECT * FROM (
    SELECT p.*, s.spot AS spot_entry, row_number() OVER (PARTITION BY p.symbol, p.as_of ORDER BY expiration_date, abs(strike - s.spot), strike) AS place
    FROM spot s JOIN pairs p ON p.symbol = s.symbol AND p.as_of = s.as_of WHERE expiration_date >= p.as_of + 7) t
  WHERE place = 1)
"""


def _signals(spark, sf):
    return views.spots(spark, sf).withColumnRenamed("spot", "spot_entry")


@query("atm_straddle", f"WITH {_CHAIN}{_PAIRS} SELECT symbol, as_of, round(spot_entry, 4) + 0.0 AS spot_entry, expiration_date, strike, round(ca, 4) + 0.0 AS call_ask, round(pa, 4) + 0.0 AS put_ask FROM atm")
def atm_straddle(spark, sf):
    table = options.atm_straddle(_signals(spark, sf), views.chain(spark, sf))
    return rounded(table, {"spot_entry": 4, "call_ask": 4, "put_ask": 4}, ("symbol", "as_of", "expiration_date", "strike"))


def _trade_ctes(hold: int) -> str:
    return _CHAIN + _PAIRS + f""",
sig AS (
  SELECT symbol, as_of, spot AS spot_entry, coalesce(lead(as_of, {hold}) OVER w, last_value(as_of) OVER f) AS exit_date,
         coalesce(lead(spot, {hold}) OVER w, last_value(spot) OVER f) AS spot_exit
  FROM spot WINDOW w AS (PARTITION BY symbol ORDER BY as_of), f AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
trades AS MATERIALIZED (
  SELECT g.symbol, g.as_of, g.exit_date, a.expiration_date, a.strike, g.spot_entry, g.spot_exit, a.ca + a.pa AS entry_debit,
         CASE WHEN g.exit_date < a.expiration_date THEN x.cb + x.pb ELSE abs(g.spot_exit - a.strike) END AS exit_value,
         CASE WHEN a.strike IS NULL THEN 'no eligible expiry' WHEN g.exit_date < a.expiration_date AND x.strike IS NULL THEN 'no exit quotes' ELSE 'traded' END AS status
  FROM sig g LEFT JOIN atm a ON a.symbol = g.symbol AND a.as_of = g.as_of
  LEFT JOIN pairs x ON x.symbol = g.symbol AND x.as_of = g.exit_date AND x.expiration_date = a.expiration_date AND x.strike = a.strike)
"""


def _with_exits(spark, sf, hold: int):
    spot = cut(views.spots(spark, sf))
    bars = spot.select("symbol", F.col("as_of").alias("bar_date"), F.col("spot").alias("close"))
    found = options.exit_lookup(bars.select("symbol", "bar_date"), bars, hold)
    return found.withColumnRenamed("bar_date", "as_of")


def _trades(spark, sf, hold: int, **params):
    return options.straddle_trades(_with_exits(spark, sf, hold), views.chain(spark, sf), **params)


@query("exit_lookup", f"WITH {_trade_ctes(5)} SELECT symbol, as_of, exit_date, round(spot_entry, 4) + 0.0 AS spot_entry, round(spot_exit, 4) + 0.0 AS spot_exit FROM sig")
def exit_lookup(spark, sf):
    return rounded(_with_exits(spark, sf, 5), {"spot_entry": 4, "spot_exit": 4}, ("symbol", "as_of", "exit_date"))


def _trade_query(name: str, hold: int, where: str):
    @query(name, f"WITH {_trade_ctes(hold)} SELECT symbol, as_of, exit_date, expiration_date, strike, status, round(entry_debit, 4) + 0.0 AS entry_debit, round(exit_value, 4) + 0.0 AS exit_value, "
                 f"CASE WHEN status = 'traded' THEN round(exit_value - entry_debit, 4) + 0.0 END AS pnl FROM trades WHERE {where}")
    def run(spark, sf):
        table = _trades(spark, sf, hold).filter(where)
        return rounded(table, {"entry_debit": 4, "exit_value": 4, "pnl": 4}, ("symbol", "as_of", "exit_date", "expiration_date", "strike", "status"))


_trade_query("straddle_trades", 5, "true")
_trade_query("mark_to_market_exit", 5, "exit_date < expiration_date AND status = 'traded'")
_trade_query("intrinsic_exit", 15, "exit_date >= expiration_date")

_SNAP = """,
si AS (SELECT *, spot_{side} AS s, strike AS k, greatest(date_diff('day', {day}, expiration_date) / 365.0::DOUBLE, 0.0) AS t, 0.2::DOUBLE AS v, true AS c FROM trades WHERE status = 'traded')
"""


@query(
    "straddle_greeks",
    f"WITH {_trade_ctes(15)}{_SNAP.format(side='exit', day='exit_date')}{greeks_sql('si', 'x', 0.05)} SELECT symbol, as_of, round(delta, 6) + 0.0 AS exit_delta, round(vega, 6) + 0.0 AS exit_vega, round(theta, 6) + 0.0 AS exit_theta, round(price, 6) + 0.0 AS exit_price FROM x",
)
def straddle_greeks(spark, sf):
    table = _trades(spark, sf, 15, greeks=True).filter("status = 'traded'")
    return rounded(table, {f"exit_{c}": 6 for c in ("delta", "vega", "theta", "price")}, ("symbol", "as_of"))


@query(
    "summarize_trades",
    f"WITH {_trade_ctes(5)}, p AS (SELECT exit_value - entry_debit AS pnl FROM trades WHERE status = 'traded') SELECT count(*) AS trade_count, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS win_rate, "
    "round(avg(pnl), 4) + 0.0 AS average_pnl, round(median(pnl), 4) + 0.0 AS median_pnl, round(sum(pnl), 4) + 0.0 AS total_pnl, round(max(pnl), 4) + 0.0 AS best_trade, round(min(pnl), 4) + 0.0 AS worst_trade FROM p",
)
def summarize_trades(spark, sf):
    table = options.summarize_trades(cut(_trades(spark, sf, 5).filter("status = 'traded'")))
    return rounded(table, {"win_rate": 6, **{c: 4 for c in ("average_pnl", "median_pnl", "total_pnl", "best_trade", "worst_trade")}}, ("trade_count",))


# --- Q hedges ------------------------------------------------------------------------

_HEDGE = f"""WITH RECURSIVE {_G},
path AS (SELECT symbol, expiration_date, strike, option_type, as_of, spot, delta,
                row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, expiration_date, strike, option_type) AS days
         FROM g WINDOW w AS (PARTITION BY symbol, expiration_date, strike, option_type ORDER BY as_of)),
fold AS (
  SELECT symbol, expiration_date, strike, option_type, i, days, -delta AS hedge, spot, 0.0::DOUBLE AS pnl, 0 AS trades, 0.0::DOUBLE AS exposure FROM path WHERE i = 1
  UNION ALL
  SELECT p.symbol, p.expiration_date, p.strike, p.option_type, p.i, p.days, CASE WHEN abs(-p.delta - f.hedge) > 0.05 THEN -p.delta ELSE f.hedge END, p.spot,
         f.pnl + f.hedge * (p.spot - f.spot), f.trades + CASE WHEN abs(-p.delta - f.hedge) > 0.05 THEN 1 ELSE 0 END, f.exposure + abs(p.delta)
  FROM fold f JOIN path p USING (symbol, expiration_date, strike, option_type) WHERE p.i = f.i + 1),
fin AS (SELECT *, CASE WHEN option_type = 'call' THEN greatest(spot - strike, 0.0) ELSE greatest(strike - spot, 0.0) END AS payoff FROM fold WHERE i = days)
SELECT symbol, expiration_date, strike, option_type, CAST(days AS INTEGER) AS days, round(payoff, 4) + 0.0 AS option_pnl, round(pnl, 4) + 0.0 AS hedge_pnl, round(payoff + pnl, 4) + 0.0 AS total_pnl,
       CAST(trades AS INTEGER) AS rebalances, round(CASE WHEN days > 1 THEN exposure / (days - 1) ELSE 0.0 END, 6) + 0.0 AS avg_delta_exposure FROM fin
"""


@query("delta_hedge_ledger", _HEDGE)
def delta_hedge_ledger(spark, sf):
    table = options.delta_hedge_ledger(views.chain(spark, sf))
    return rounded(
        table, {"option_pnl": 4, "hedge_pnl": 4, "total_pnl": 4, "avg_delta_exposure": 6},
        ("symbol", "expiration_date", "strike", "option_type", "days", "rebalances"),
    )


def positions(spark, sf):
    greeks = options.chain_greeks(views.chain(spark, sf)).filter("strike % 50 = 0")
    return greeks.withColumn("portfolio", F.col("symbol"))


_POS = _G + ", pos AS (SELECT *, symbol AS portfolio FROM g WHERE strike % 50 = 0)"


@query("portfolio_greeks", f"WITH {_POS} SELECT portfolio, " + ", ".join(f"round(sum({c}), 4) + 0.0 AS {c}" for c in options.GREEKS) + " FROM pos GROUP BY 1")
def portfolio_greeks(spark, sf):
    return rounded(options.portfolio_greeks(positions(spark, sf)), {c: 4 for c in options.GREEKS}, ("portfolio",))


@query(
    "vega_hedge",
    f"WITH {_POS}, ex AS (SELECT symbol, as_of, sum(vega) AS primary_vega FROM pos GROUP BY 1, 2), cand AS (SELECT symbol, as_of, expiration_date, strike, option_type, round(ask, 6) AS price, round(vega, 8) AS vega FROM g WHERE strike % 50 <> 0), "
    "pick AS (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY vega <= 0, CASE WHEN vega > 0 THEN price / vega ELSE -abs(vega) END, expiration_date, strike, option_type) AS place FROM cand JOIN ex USING (symbol, as_of) WHERE primary_vega > 0) "
    "SELECT symbol, as_of, expiration_date, strike, option_type, round(primary_vega / CASE WHEN vega > 0 THEN vega ELSE 1e-6 END, 3) + 0.0 AS quantity, round(CASE WHEN vega > 0 THEN primary_vega ELSE primary_vega / 1e-6 * vega END, 4) + 0.0 AS net_vega, 'short' AS side FROM pick WHERE place = 1",
)
def vega_hedge(spark, sf):
    exposure = positions(spark, sf).groupBy("symbol", "as_of").agg(F.sum("vega").alias("primary_vega"))
    candidates = options.chain_greeks(views.chain(spark, sf)).filter("strike % 50 <> 0").select(
        "symbol", "as_of", "expiration_date", "strike", "option_type", F.round("ask", 6).alias("price"), F.round("vega", 8).alias("vega")
    )
    table = options.vega_hedge(exposure, candidates, ["symbol", "as_of"])
    return rounded(table, {"quantity": 3, "net_vega": 4}, (*_KEY, "side"))


@query(
    "portfolio_greeks_chain",
    f"WITH {_G} SELECT symbol AS portfolio, " + ", ".join(f"round(sum({c}), 4) + 0.0 AS {c}" for c in options.GREEKS) + " FROM g GROUP BY 1",
)
def portfolio_greeks_chain(spark, sf):
    """Every contract is a position of its symbol's portfolio."""
    held = options.chain_greeks(views.chain(spark, sf)).withColumn("portfolio", F.col("symbol"))
    return rounded(options.portfolio_greeks(held), {c: 4 for c in options.GREEKS}, ("portfolio",))


_PARTED = _G + ", pt AS (SELECT *, expiration_date = min(expiration_date) OVER (PARTITION BY symbol, as_of) AS held FROM g)"


@query(
    "vega_hedge_by_expiry",
    f"WITH {_PARTED}, ex AS (SELECT symbol, as_of, sum(vega) AS primary_vega FROM pt WHERE held GROUP BY 1, 2), cand AS (SELECT symbol, as_of, expiration_date, strike, option_type, round(ask, 6) AS price, round(vega, 8) AS vega FROM pt WHERE NOT held), "
    "pick AS (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY vega <= 0, CASE WHEN vega > 0 THEN price / vega ELSE -abs(vega) END, expiration_date, strike, option_type) AS place FROM cand JOIN ex USING (symbol, as_of) WHERE primary_vega > 0) "
    "SELECT symbol, as_of, expiration_date, strike, option_type, round(primary_vega / CASE WHEN vega > 0 THEN vega ELSE 1e-6 END, 3) + 0.0 AS quantity, round(CASE WHEN vega > 0 THEN primary_vega ELSE primary_vega / 1e-6 * vega END, 4) + 0.0 AS net_vega, 'short' AS side FROM pick WHERE place = 1",
)
def vega_hedge_by_expiry(spark, sf):
    """The nearest expiry is held, all later ones are candidates: every contract takes part."""
    greeks = cut(options.chain_greeks(views.chain(spark, sf)))
    first = greeks.groupBy("symbol", "as_of").agg(F.min("expiration_date").alias("_first"))
    parted = greeks.join(first, ["symbol", "as_of"])
    exposure = parted.filter("expiration_date = _first").groupBy("symbol", "as_of").agg(F.sum("vega").alias("primary_vega"))
    candidates = parted.filter("expiration_date <> _first").select(
        "symbol", "as_of", "expiration_date", "strike", "option_type", F.round("ask", 6).alias("price"), F.round("vega", 8).alias("vega")
    )
    table = options.vega_hedge(exposure, candidates, ["symbol", "as_of"])
    return rounded(table, {"quantity": 3, "net_vega": 4}, (*_KEY, "side"))


# --- A7, A8 sources --------------------------------------------------------------------


_BAR = {c: 6 for c in ("open", "high", "low", "close", "volume")}


def _interval_sql(minutes: int) -> str:
    return (
        f"WITH {views.TICKS_SQL} SELECT symbol, time_bucket(INTERVAL {minutes} MINUTE, ts) AS bar_start, round(min_by(price, ts), 6) + 0.0 AS open, round(max(price), 6) + 0.0 AS high, "
        "round(min(price), 6) + 0.0 AS low, round(max_by(price, ts), 6) + 0.0 AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2"
    )


@query("trades_to_bars_5m", _interval_sql(5))
def trades_to_bars_5m(spark, sf):
    return rounded(interval_bars(views.price_events(spark, sf), "5 minutes"), _BAR, ("symbol", "bar_start"))


@query("trades_to_bars_1h", _interval_sql(60))
def trades_to_bars_1h(spark, sf):
    return rounded(interval_bars(views.price_events(spark, sf), "1 hour"), _BAR, ("symbol", "bar_start"))


@query(
    "normalize_chain",
    f"WITH {_CHAIN} SELECT symbol, as_of, expiration_date, strike, option_type, CASE WHEN strike % 35 <> 0 THEN round(bid, 4) + 0.0 END AS bid, round(ask, 4) + 0.0 AS ask, round(implied_volatility, 6) + 0.0 AS implied_volatility FROM chain",
)
def normalize_chain_query(spark, sf):
    raw = views.chain(spark, sf).select(
        "symbol", "as_of", F.col("expiration_date").cast("string").alias("expiration"), F.col("strike").cast("string").alias("strike"),
        F.col("option_type").alias("optionType"), F.when(F.col("strike") % 35 == 0, "n/a").otherwise(F.col("bid").cast("string")).alias("bid"),
        F.col("ask").cast("string").alias("ask"), F.col("implied_volatility").cast("string").alias("impliedVolatility"),
    )
    return rounded(normalize_chain(raw), {"bid": 4, "ask": 4, "implied_volatility": 6}, _KEY)


# --- I intraday --------------------------------------------------------------------------

_I = views.INTRADAY_SQL
_PPY = 252 * 24
_DAYLOGS = _I + """,
dl AS (SELECT *, CAST(bar_start AS DATE) AS day, lag(close) OVER (PARTITION BY symbol, CAST(bar_start AS DATE) ORDER BY bar_start) AS pc FROM ibars),
lg AS (SELECT *, ln(close / pc) AS r, ln(open / pc) AS gap, pow(ln(high / low), 2) AS hl,
              ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs,
              (pow(ln(close / open) - ln(high / close), 2) + pow(ln(high / close) - ln(close / low), 2) + pow(ln(close / low) - ln(close / open), 2)) / 2 AS rs2 FROM dl)
"""
_EST = {
    "close_to_close_vol": f"coalesce(stddev_samp(r) * sqrt({_PPY}.0), 0.0)",
    "parkinson_vol": "CASE WHEN count(*) >= 2 THEN sqrt(sum(hl) / (count(*) * 4 * ln(2))) * sqrt(252.0) ELSE 0.0 END",
    "rogers_satchell_vol": "CASE WHEN count(rs) >= 2 THEN sqrt(greatest(avg(rs), 0.0)) * sqrt(252.0) ELSE 0.0 END",
    "yang_zhang_vol": "sqrt(0.34 * pow(stddev_samp(gap), 2) + 0.33 * avg(rs) + 0.33 * pow(stddev_samp(r), 2)) * sqrt(252.0)",
}


def _estimator(name: str, expression: str, published: bool = True, column: str | None = None):
    column = column or name

    @query(name, f"WITH {_DAYLOGS} SELECT symbol, day, round({expression}, 6) + 0.0 AS {column} FROM lg GROUP BY 1, 2")
    def run(spark, sf):
        table = intraday.estimators(views.bars_intraday(spark, sf), periods_per_year=_PPY, published_rs=published)
        return rounded(table, {column: 6}, ("symbol", "day"))


for _n, _e in _EST.items():
    _estimator(_n, _e)
_estimator("rogers_satchell_squares", _EST["rogers_satchell_vol"].replace("rs", "rs2"), False, "rogers_satchell_vol")


@query("vwap", f"WITH {_I} SELECT symbol, CAST(bar_start AS DATE) AS day, round(sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0), 6) + 0.0 AS VWAP FROM ibars GROUP BY 1, 2")
def vwap(spark, sf):
    return rounded(intraday.vwap(views.bars_intraday(spark, sf)), {"VWAP": 6}, ("symbol", "day"))


_IW = "(PARTITION BY symbol ORDER BY bar_start"
_IFEAT = _I + f""",
ir AS (SELECT *, ln(close / lag(close) OVER {_IW})) AS r FROM ibars),
ifeat AS (
  SELECT *, sum((high + low + close) / 3 * volume) OVER {_IW}) / nullif(sum(volume) OVER {_IW}), 0) AS VWAP,
         (close - open) / open * volume / avg(volume) OVER (PARTITION BY symbol) AS Volume_Weighted_Return,
         """ + ", ".join(
    f"CASE WHEN count(r) OVER {_IW} ROWS {n - 1} PRECEDING) >= {n} THEN stddev_samp(r) OVER {_IW} ROWS {n - 1} PRECEDING) * sqrt({_PPY}.0) END AS {c}"
    for c, n in intraday.INTRADAY_WINDOWS.items()
) + " FROM ir)"


def _intraday_query(name: str, columns: list[str]):
    @query(name, f"WITH {_IFEAT} SELECT symbol, bar_start, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in columns)} FROM ifeat")
    def run(spark, sf):
        table = intraday.intraday_features(views.bars_intraday(spark, sf), _PPY)
        return rounded(table, {c: 6 for c in columns}, ("symbol", "bar_start"))


_intraday_query("cumulative_vwap", ["VWAP"])
_intraday_query("volume_weighted_return", ["Volume_Weighted_Return"])
_intraday_query("intraday_vol", list(intraday.INTRADAY_WINDOWS))

_ALL_TICK = ["VWAP", *intraday.INTRADAY_WINDOWS, "Volume_Weighted_Return"]
_RES = _IFEAT + """,
res AS (SELECT symbol, CAST(bar_start AS DATE) AS day, """ + ", ".join(
    f"max_by({c}, bar_start) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _ALL_TICK[:-1]
) + ", sum(Volume_Weighted_Return) AS Volume_Weighted_Return FROM ifeat GROUP BY 1, 2)"


def _resampled(spark, sf):
    return intraday.daily_resample(intraday.intraday_features(views.bars_intraday(spark, sf), _PPY))


@query("daily_resample", f"WITH {_RES} SELECT symbol, day, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _ALL_TICK)} FROM res")
def daily_resample(spark, sf):
    return rounded(_resampled(spark, sf), {c: 6 for c in _ALL_TICK}, ("symbol", "day"))


@query(
    "add_tick_features",
    f"WITH {_RES}, wider AS (SELECT symbol, CAST(ts AS DATE) + CAST(n AS INTEGER) AS bar_date, max_by(price, ts) AS close FROM ticks, range(0, 2) r(n) GROUP BY 1, 2) "
    f"SELECT w.symbol, w.bar_date, round(close, 6) + 0.0 AS close, {', '.join(f'round({c}, 6) + 0.0 AS Tick_{c}' for c in _ALL_TICK)} FROM wider w LEFT JOIN res r ON r.symbol = w.symbol AND r.day = w.bar_date",
)
def add_tick_features(spark, sf):
    """Daily bars that reach one day beyond the ticks."""
    ticks = views.price_events(spark, sf)
    daily = (
        ticks.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
        .groupBy("symbol", F.expr("date_add(to_date(ts), n)").alias("bar_date")).agg(F.max_by("price", "ts").alias("close"))
    )
    table = intraday.add_tick_features(daily, _resampled(spark, sf))
    return rounded(table, {"close": 6, **{f"Tick_{c}": 6 for c in _ALL_TICK}})


# --- J implied volatility features -----------------------------------------------------------

_IV = _CHAIN + """,
pe AS (
  SELECT symbol, as_of, expiration_date,
         coalesce(min_by(implied_volatility, strike) FILTER (WHERE option_type = 'call' AND strike >= spot), 0.2) AS ci,
         coalesce(max_by(implied_volatility, strike) FILTER (WHERE option_type = 'put' AND strike <= spot), 0.2) AS pi,
         max_by(implied_volatility, strike) FILTER (WHERE option_type = 'call' AND strike > spot) AS oc,
         min_by(implied_volatility, strike) FILTER (WHERE option_type = 'put' AND strike < spot) AS op
  FROM chain WHERE expiration_date >= as_of GROUP BY 1, 2, 3),
lv AS (SELECT *, (ci + pi) / 2 AS atm, coalesce(oc, ci) - coalesce(op, pi) AS skew FROM pe),
iv AS (SELECT symbol, as_of, min_by(atm, expiration_date) AS IV_ATM, min_by(skew, expiration_date) AS IV_Skew,
              CASE WHEN count(*) >= 2 THEN min_by(atm, expiration_date) / max_by(atm, expiration_date) ELSE 0.95 END AS IV_Term_Structure FROM lv GROUP BY 1, 2)
"""
_IV_COLS = {c: 6 for c in implied.DEFAULTS}


@query("iv_features", f"WITH {_IV} SELECT symbol, as_of, round(IV_ATM, 6) + 0.0 AS IV_ATM, round(IV_Skew, 6) + 0.0 AS IV_Skew, round(IV_Term_Structure, 6) + 0.0 AS IV_Term_Structure, round(IV_ATM, 6) + 0.0 AS VIX_Proxy FROM iv")
def iv_features(spark, sf):
    return rounded(implied.iv_features(views.chain(spark, sf)), _IV_COLS, ("symbol", "as_of"))


@query(
    "iv_defaults",
    f"WITH {_IV}, days AS (SELECT symbol, CAST(as_of + CAST(n AS INTEGER) AS DATE) AS bar_date FROM spot, range(0, 2) r(n) GROUP BY 1, 2) "
    "SELECT d.symbol, d.bar_date, round(coalesce(IV_ATM, 0.2), 6) + 0.0 AS IV_ATM, round(coalesce(IV_Skew, 0.02), 6) + 0.0 AS IV_Skew, "
    "round(coalesce(IV_Term_Structure, 0.95), 6) + 0.0 AS IV_Term_Structure, round(coalesce(IV_ATM, 0.18), 6) + 0.0 AS VIX_Proxy "
    "FROM days d LEFT JOIN iv ON iv.symbol = d.symbol AND iv.as_of = d.bar_date",
)
def iv_defaults(spark, sf):
    days = views.spots(spark, sf).select(
        "symbol", F.explode(F.array(F.col("as_of"), F.date_add("as_of", 1))).alias("bar_date")
    ).distinct()
    return rounded(implied.attach_iv(days, implied.iv_features(views.chain(spark, sf))), _IV_COLS)
