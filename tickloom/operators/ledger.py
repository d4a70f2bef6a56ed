"""Trade ledger of a long-volatility strategy on scored bars.

A ledger group is one model, fold and symbol.  Its rows are the trading days of
one test (or train) period, one per (symbol, date), so the calendar bounds the
group (some thousand rows) and windows over it are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Trading costs and limits (fixed defaults).
ACCOUNT = 100_000.0
MAX_POSITION = 0.10
MAX_DRAWDOWN = 0.20
SPREAD = 0.001
SLIPPAGE = 0.0005
COMMISSION = 0.0
FIXED_POSITION = 0.02
MIN_STRENGTH = 0.55
PREMIUM_MULTIPLIER = 1.0
RISK_FREE = 0.05
RISK_PER_TRADE = 0.01
KELLY_SCALE = 0.25


def position_size(
    strength: Column, vol: Column, kelly: Column, method: str = "kelly", account: float = ACCOUNT
) -> Column:
    if method == "fixed":
        return F.lit(account * FIXED_POSITION)
    by_risk = account * RISK_PER_TRADE / F.greatest(vol, F.lit(0.001))
    return F.least(by_risk * kelly * strength, F.lit(account * MAX_POSITION))


def trade_candidates(
    scored: DataFrame, keys: list[str], kelly: Column, method: str = "kelly", vol: str = "Volatility_20d",
    account: float = ACCOUNT,
) -> DataFrame:
    """Signals with a next valid row in their group, their profit and size."""
    days = Window.partitionBy(*keys).orderBy("bar_date")
    ahead = scored.withColumn("exit_price", F.lead("close").over(days))
    price = F.col("close")
    profit = (
        F.abs(F.try_divide(F.col("exit_price") - price, price)) - F.col(vol) * PREMIUM_MULTIPLIER
        - (SPREAD + 2 * SLIPPAGE) - COMMISSION / F.greatest(price, F.lit(1.0))
    )
    return (
        ahead.filter(F.col("pred") & (F.col("score") >= MIN_STRENGTH) & F.col("exit_price").isNotNull())
        .withColumns({
            "pnl_pct": profit,
            "position_size": position_size(F.col("score"), F.col(vol), kelly, method, account),
        })
        .withColumn("pnl", F.when(F.col("position_size") > 0, F.col("position_size") * F.col("pnl_pct")).otherwise(0.0))
    )


def run_ledger(
    scored: DataFrame, keys: list[str], kelly: Column | None = None, method: str = "kelly",
    account: float = ACCOUNT, max_drawdown: float = MAX_DRAWDOWN, vol: str = "Volatility_20d",
) -> DataFrame:
    """Trades with the equity curve, stopped once the account lost max_drawdown.

    `vol` names the column of unscaled daily volatility.
    """
    kelly = F.lit(FIXED_POSITION) if kelly is None else kelly
    return apply_stop(trade_candidates(scored, keys, kelly, method, vol, account), keys, account, max_drawdown)


def apply_stop(
    trades: DataFrame, keys: list[str], account: float = ACCOUNT, max_drawdown: float = MAX_DRAWDOWN
) -> DataFrame:
    """Cut the candidates of each group at the drawdown limit.

    Sizes do not depend on the equity, so the stop is a running maximum of
    "equity before this signal is below the limit".
    """
    days = Window.partitionBy(*keys).orderBy("bar_date")
    before = F.coalesce(F.sum("pnl").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    trades = trades.withColumn("_breach", (before / account < -max_drawdown).cast("int"))
    upto = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = trades.withColumn("_stopped", F.max("_breach").over(upto)).filter("_stopped = 0 AND position_size > 0")
    return open_.withColumn("equity_return", F.sum("pnl").over(upto) / account).select(
        *keys, "bar_date", F.col("close").alias("entry_price"), "exit_price",
        F.col("score").alias("strength"), "position_size", "pnl", "pnl_pct", "equity_return",
    )


def kelly_fraction(train_trades: DataFrame, keys: list[str], min_trades: int = 10) -> DataFrame:
    """Position fraction per group from its train ledger.

    Too few or one-sided trades give the fixed fraction.
    """
    win, loss = F.col("pnl_pct") > 0, F.col("pnl_pct") < 0
    stats = train_trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(win).alias("_w"), F.count_if(loss).alias("_l"),
        F.avg(F.when(win, F.col("pnl_pct"))).alias("_aw"),
        F.abs(F.avg(F.when(loss, F.col("pnl_pct")))).alias("_al"),
    )
    p, odds = F.col("_w") / F.col("trades"), F.try_divide("_aw", "_al")
    kelly = F.try_divide(p * odds - (1 - p), odds) * KELLY_SCALE
    enough = (F.col("trades") >= min_trades) & (F.col("_w") > 0) & (F.col("_l") > 0)
    return stats.select(
        *keys, "trades",
        F.when(~enough, F.lit(FIXED_POSITION))
        .otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(kelly, F.lit(MAX_POSITION))), F.lit(0.0)))
        .alias("kelly"),
    )


def _ratio(mean: Column, deviation: Column) -> Column:
    value = F.try_divide(mean - RISK_FREE / 252, deviation) * F.sqrt(F.lit(252.0))
    return F.coalesce(value, F.lit(0.0))


def ledger_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate, profit factor, returns, Sharpe, Sortino and maximum drawdown.

    Steps of the equity curve are per trade and start from 1.
    """
    days = Window.partitionBy(*keys).orderBy("bar_date")
    upto = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = trades.withColumn("_equity", 1 + F.col("equity_return"))
    before = F.coalesce(F.lag("_equity").over(days), F.lit(1.0))
    peak = F.greatest(F.max("_equity").over(upto), F.lit(1.0))
    curve = curve.withColumns({
        "_step": F.try_divide(F.col("_equity"), before) - 1,
        "_down": F.col("_equity") / peak - 1,
    })
    win, loss = F.col("pnl_pct") > 0, F.col("pnl_pct") < 0
    gained, lost = F.sum(F.when(win, F.col("pnl_pct"))), F.abs(F.sum(F.when(loss, F.col("pnl_pct"))))
    falling = F.when(F.col("_step") < 0, F.col("_step"))
    n = F.count("*")
    total = F.max_by("equity_return", "bar_date")
    zero = F.lit(0.0)
    return curve.groupBy(*keys).agg(
        n.alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(loss).alias("losing_trades"),
        F.avg(win.cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, F.col("pnl_pct"))), zero).alias("avg_win"),
        F.coalesce(F.abs(F.avg(F.when(loss, F.col("pnl_pct")))), zero).alias("avg_loss"),
        F.when(lost > 0, F.coalesce(gained, zero) / lost).otherwise(zero).alias("profit_factor"),
        total.alias("total_return"),
        F.when(n < 252, total * (252 / n)).otherwise(total).alias("annual_return"),
        _ratio(F.avg("_step"), F.stddev_pop("_step")).alias("sharpe_ratio"),
        _ratio(F.avg("_step"), F.stddev_pop(falling)).alias("sortino_ratio"),
        F.least(F.min("_down"), zero).alias("max_drawdown"),
    )
