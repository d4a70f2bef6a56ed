"""Option chains: greeks, validation, straddles and hedges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import small
from tickloom.functions.blocks import rolling
from tickloom.functions.prefix import exact_percentiles
from tickloom.functions.scalars import attach_row
from tickloom.functions.pricing import BRACKET, implied_vol, is_call, with_greeks
from tickloom.functions.rolling import lead

GREEKS = ("delta", "gamma", "vega", "theta", "rho")


def years_to_expiry(floor: float | None = None) -> Column:
    years = F.datediff("expiration_date", "as_of") / F.lit(365.0)
    return years if floor is None else F.greatest(years, F.lit(floor))


def chain_greeks(chain: DataFrame, rate: float = 0.05, years: Column | None = None) -> DataFrame:
    """Price and greeks of every chain row; a missing type counts as a call."""
    kind = F.coalesce(F.col("option_type"), F.lit("call"))
    return with_greeks(
        chain, F.col("spot"), F.col("strike"), years_to_expiry() if years is None else years,
        F.col("implied_volatility"), is_call(kind), rate,
    )


def with_implied_vol(
    chain: DataFrame, quote: Column, rate: float = 0.05, years: Column | None = None, out: str = "bs_iv", bracket: tuple[float, float] = BRACKET
) -> DataFrame:
    years = years_to_expiry(0.001) if years is None else years
    return chain.withColumn(
        out, implied_vol(quote, F.col("spot"), F.col("strike"), years, F.lit(rate), is_call(F.col("option_type")), bracket)
    )


def chain_errors(
    chain: DataFrame, rate: float = 0.05, tolerance: float = 0.10, years: float | None = None, solve_iv: bool = True
) -> DataFrame:
    """Per-contract pricing, implied-volatility and delta errors against the quotes."""
    term = years_to_expiry(0.001) if years is None else F.lit(years)
    quoted = chain.withColumns({"T": term, "market_mid": (F.col("bid") + F.col("ask")) / 2})
    vol = F.coalesce("implied_volatility", F.lit(0.20))
    priced = with_greeks(
        quoted, F.col("spot"), F.col("strike"), F.col("T"), vol, is_call(F.col("option_type")), rate, "bs_"
    ).withColumn("market_iv", vol)
    priced = priced.withColumn(
        "pricing_error_pct", F.abs(F.col("bs_price") - F.col("market_mid")) / (F.col("market_mid") + 1e-6)
    ).withColumn("within_tolerance", F.col("pricing_error_pct") <= tolerance)
    if solve_iv:
        priced = with_implied_vol(priced, F.col("market_mid"), rate, F.col("T")).withColumn(
            "iv_error_pct", F.abs(F.col("bs_iv") - F.col("market_iv")) / (F.col("market_iv") + 1e-6)
        )
    delta = F.abs(F.col("bs_delta") - F.col("delta")) if "delta" in chain.columns else F.lit(None).cast("double")
    return priced.withColumn("delta_error", delta).drop("bs_gamma", "bs_vega", "bs_theta", "bs_rho")


def validate_chain(chain: DataFrame, keys=("symbol", "as_of"), **params) -> DataFrame:
    """Averages of `chain_errors` per chain."""
    errors = chain_errors(chain, **params)
    averages = [F.avg("iv_error_pct").alias("avg_iv_error_pct")] if "iv_error_pct" in errors.columns else []
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n_contracts"), F.avg("pricing_error_pct").alias("avg_pricing_error_pct"),
        F.avg("delta_error").alias("avg_delta_error"),
        F.avg(F.col("within_tolerance").cast("double")).alias("within_tolerance_pct"), *averages,
    )


def nearest_expiry(chain: DataFrame) -> DataFrame:
    """Earliest expiry on or after the date, else the latest one."""
    day = F.col("expiration_date")
    return chain.groupBy("symbol", "as_of").agg(
        F.coalesce(F.min(F.when(day >= F.col("as_of"), day)), F.max(day)).alias("nearest_expiry")
    )


def straddle_quotes(chain: DataFrame) -> DataFrame:
    """One row per (symbol, as_of, expiry, strike) with the quotes of both legs."""
    call = is_call(F.col("option_type"))
    put = F.lower("option_type").startswith("p")
    return chain.groupBy("symbol", "as_of", "expiration_date", "strike").agg(
        F.count_if(call).alias("calls"), F.count_if(put).alias("puts"),
        *[F.min(F.when(leg, F.col(q))).alias(f"{name}_{q}") for name, leg in (("call", call), ("put", put)) for q in ("bid", "ask")],
    )


def atm_straddle(signals: DataFrame, chain: DataFrame, min_days: int = 7) -> DataFrame:
    """First expiry at least min_days away, then the strike nearest the spot.

    `signals` has (symbol, as_of, spot_entry).  Expiry and strike follow from
    one minimum over (expiry, distance, strike) per signal.
    """
    quotes = straddle_quotes(chain)
    eligible = signals.select("symbol", "as_of", "spot_entry").join(quotes, ["symbol", "as_of"]).filter(
        F.col("expiration_date") >= F.date_add("as_of", min_days)
    )
    first = F.min(F.struct(
        "expiration_date", F.abs(F.col("strike") - F.col("spot_entry")).alias("distance"), "strike",
        "call_ask", "put_ask", "calls", "puts",
    ))
    picked = eligible.groupBy("symbol", "as_of", "spot_entry").agg(first.alias("b"))
    return picked.select(
        "symbol", "as_of", "spot_entry", "b.expiration_date", "b.strike", "b.call_ask", "b.put_ask",
        ((F.col("b.calls") > 0) & (F.col("b.puts") > 0)).alias("has_pair"),
    )


def straddle_trades(
    signals: DataFrame, chain: DataFrame, min_days: int = 7, greeks: bool = False,
    volatility: float = 0.20, rate: float = 0.05,
) -> DataFrame:
    """Buy the straddle at the ask on the signal date, leave it at the exit date.

    `signals` has (symbol, as_of, spot_entry, exit_date, spot_exit).  Before
    expiry the exit is the bid of the same contracts, afterwards the intrinsic
    value.  `status` says why a signal has no trade; nothing is dropped.
    """
    entry = atm_straddle(signals, chain, min_days)
    exits = straddle_quotes(chain).select(
        "symbol", F.col("as_of").alias("exit_date"), "expiration_date", "strike",
        (F.col("call_bid") + F.col("put_bid")).alias("_mtm"),
        ((F.col("calls") > 0) & (F.col("puts") > 0)).alias("_quoted"),
    )
    joined = signals.join(entry.drop("spot_entry"), ["symbol", "as_of"], "left").join(
        exits, ["symbol", "exit_date", "expiration_date", "strike"], "left"
    )
    early = F.col("exit_date") < F.col("expiration_date")
    debit = F.col("call_ask") + F.col("put_ask")
    value = F.when(early, F.col("_mtm")).otherwise(F.abs(F.col("spot_exit") - F.col("strike")))
    status = (
        F.when(F.col("expiration_date").isNull(), "no eligible expiry")
        .when(~F.col("has_pair"), "no call/put pair")
        .when(debit.isNull(), "no ask at entry")
        .when(early & F.col("_quoted").isNull(), "no exit quotes")
        .when(early & (~F.col("_quoted") | F.col("_mtm").isNull()), "no bid at exit")
        .otherwise("traded")
    )
    trades = joined.withColumns({"status": status, "entry_debit": debit, "exit_value": value}).withColumn(
        "pnl", F.when(F.col("status") == "traded", F.col("exit_value") - F.col("entry_debit"))
    )
    columns = ["symbol", "as_of", "exit_date", "expiration_date", "strike", "spot_entry", "spot_exit", "entry_debit", "exit_value", "pnl", "status"]
    if greeks:
        for side, day, spot in (("entry", "as_of", "spot_entry"), ("exit", "exit_date", "spot_exit")):
            term = F.greatest(F.datediff("expiration_date", day) / F.lit(365.0), F.lit(0.0))
            trades = with_greeks(trades, F.col(spot), F.col("strike"), term, F.lit(volatility), F.lit(True), rate, f"{side}_")
            columns += [f"{side}_{g}" for g in ("price", *GREEKS)]
    return trades.select(*columns)


@rolling(lookahead=lambda p: p["hold_rows"], lookback=0)
def _later_row(bars: DataFrame, hold_rows: int) -> DataFrame:
    return bars.withColumns({
        "exit_date": lead(F.col("bar_date"), hold_rows), "spot_exit": lead(F.col("close"), hold_rows),
    })


def exit_lookup(alerts: DataFrame, bars: DataFrame, hold_rows: int = 5) -> DataFrame:
    """Entry and exit of each alert, the exit capped at the last row; alerts without a bar are skipped."""
    last = bars.groupBy("symbol").agg(
        F.max("bar_date").alias("_last_date"), F.max_by("close", "bar_date").alias("_last_close")
    )
    dated = _later_row(bars.select("symbol", "bar_date", "close"), hold_rows).join(small(last), "symbol").select(
        "symbol", "bar_date", F.col("close").alias("spot_entry"),
        F.coalesce("exit_date", "_last_date").alias("exit_date"),
        F.coalesce("spot_exit", "_last_close").alias("spot_exit"),
    )
    return alerts.join(dated, ["symbol", "bar_date"])


def summarize_trades(trades: DataFrame) -> DataFrame:
    """One row also for an empty table."""
    stats = trades.agg(
        F.count("pnl").alias("trade_count"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl").alias("average_pnl"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        F.max("pnl").alias("best_trade"), F.min("pnl").alias("worst_trade"),
    )
    median = exact_percentiles(trades, [], "pnl", [0.5], "_m").select(F.col("_m")[0].alias("median_pnl"))
    return attach_row(stats, median)


def delta_hedge_ledger(paths: DataFrame, rate: float = 0.05, threshold: float = 0.05) -> DataFrame:
    """Delta hedge along the observed spots of each contract.

    `paths` are chain rows; a contract is (symbol, expiration_date, strike,
    option_type).  The hedge held before a move earns the move; it is reset to
    minus delta when it is off by more than the threshold.  That reset depends
    on the previous hedge, so each path is folded in order.  A path has one row
    per day of the contract's life, which bounds its length.
    """
    contract = ["symbol", "expiration_date", "strike", "option_type"]
    steps = chain_greeks(paths, rate).groupBy(*contract).agg(
        F.sort_array(F.collect_list(F.struct("as_of", "spot", "delta"))).alias("path")
    )
    first = F.get("path", F.lit(0))
    start = F.struct(
        (-first["delta"]).alias("hedge"), first["spot"].alias("spot"), F.lit(0.0).alias("pnl"),
        F.lit(0).alias("trades"), F.lit(0.0).alias("exposure"),
    )

    def advance(state, step):
        off = F.abs(-step["delta"] - state["hedge"]) > threshold
        return F.struct(
            F.when(off, -step["delta"]).otherwise(state["hedge"]).alias("hedge"), step["spot"].alias("spot"),
            (state["pnl"] + state["hedge"] * (step["spot"] - state["spot"])).alias("pnl"),
            (state["trades"] + off.cast("int")).alias("trades"),
            (state["exposure"] + F.abs(step["delta"])).alias("exposure"),
        )

    later = F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))
    folded = steps.withColumn("_s", F.aggregate(later, start, advance))
    payoff = F.when(is_call(F.col("option_type")), F.greatest(F.col("_s.spot") - F.col("strike"), F.lit(0.0))).otherwise(
        F.greatest(F.col("strike") - F.col("_s.spot"), F.lit(0.0))
    )
    moves = F.size("path") - 1
    return folded.select(
        *contract, (moves + 1).alias("days"), payoff.alias("option_pnl"), F.col("_s.pnl").alias("hedge_pnl"),
        (payoff + F.col("_s.pnl")).alias("total_pnl"), F.col("_s.trades").alias("rebalances"),
        F.when(moves > 0, F.col("_s.exposure") / moves).otherwise(0.0).alias("avg_delta_exposure"),
    )


def vega_hedge(exposures: DataFrame, contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Cheapest non-negative hedge of a vega exposure.

    With one equality constraint the optimum uses a single contract, the one
    with the lowest price per unit of vega; when no contract has the right
    sign the largest absolute vega is used.  `exposures` has (keys,
    primary_vega); `contracts` has (keys, contract columns, vega, price).
    """
    others = [c for c in contracts.columns if c not in keys]
    pairs = contracts.join(exposures, keys)
    right = (F.signum("vega") == F.signum("primary_vega")) & (F.col("vega") != 0)
    row = F.struct(*others)
    id_order = [F.col(c) for c in others]
    best = F.min(F.when(right, F.struct((F.col("price") / F.abs("vega")).alias("cost"), *id_order)))
    largest = F.min(F.struct((-F.abs("vega")).alias("cost"), *id_order))
    picked = pairs.groupBy(*keys, "primary_vega").agg(F.coalesce(best, largest).alias("b"))
    quantity = F.col("primary_vega") / F.when(
        F.signum("b.vega") == F.signum("primary_vega"), F.col("b.vega")
    ).otherwise(F.greatest(F.col("b.vega"), F.lit(1e-6)))
    return picked.filter("primary_vega <> 0").select(
        *keys, "primary_vega", *[F.col(f"b.{c}").alias(c) for c in others], quantity.alias("quantity"),
        (quantity * F.col("b.vega")).alias("net_vega"),
        F.when(F.col("primary_vega") > 0, "short").otherwise("long").alias("side"),
    )


def portfolio_greeks(positions: DataFrame, portfolios: DataFrame | None = None) -> DataFrame:
    """Sum of the greeks per portfolio; listed portfolios without positions get zeros."""
    sums = positions.groupBy("portfolio").agg(*[F.sum(g).alias(g) for g in GREEKS])
    if portfolios is not None:
        sums = portfolios.select("portfolio").distinct().join(sums, "portfolio", "left")
    return sums.na.fill(0.0, subset=list(GREEKS))
