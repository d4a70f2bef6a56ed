"""Implied-volatility features from chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.pricing import is_call

# Values used when no chain is available (fixed defaults).
DEFAULTS = {"IV_ATM": 0.20, "IV_Skew": 0.02, "IV_Term_Structure": 0.95, "VIX_Proxy": 0.18}


def iv_features(chain: DataFrame) -> DataFrame:
    """ATM level, skew and term structure per (symbol, as_of); needs a `spot` column.

    The level is the mean of the first call at or above the spot and the last
    put at or below it, at the nearest expiry.  The skew compares the highest
    call with the lowest put.
    """
    call, strike, spot = is_call(F.col("option_type")), F.col("strike"), F.col("spot")

    def iv_at(pick, condition: Column) -> Column:
        return pick("implied_volatility", F.when(condition, strike))

    per_expiry = chain.filter("expiration_date >= as_of").groupBy("symbol", "as_of", "expiration_date").agg(
        F.coalesce(iv_at(F.min_by, call & (strike >= spot)), F.lit(DEFAULTS["IV_ATM"])).alias("_call"),
        F.coalesce(iv_at(F.max_by, ~call & (strike <= spot)), F.lit(DEFAULTS["IV_ATM"])).alias("_put"),
        iv_at(F.max_by, call & (strike > spot)).alias("_otm_call"),
        iv_at(F.min_by, ~call & (strike < spot)).alias("_otm_put"),
    )
    levels = per_expiry.withColumns({
        "atm": (F.col("_call") + F.col("_put")) / 2,
        "skew": F.coalesce("_otm_call", "_call") - F.coalesce("_otm_put", "_put"),
    })
    by_expiry = levels.groupBy("symbol", "as_of").agg(
        F.min_by("atm", "expiration_date").alias("IV_ATM"), F.min_by("skew", "expiration_date").alias("IV_Skew"),
        F.max_by("atm", "expiration_date").alias("_far"), F.count("*").alias("_expiries"),
    )
    term = F.when(F.col("_expiries") >= 2, F.try_divide("IV_ATM", "_far"))
    return by_expiry.select(
        "symbol", "as_of", "IV_ATM", "IV_Skew",
        F.coalesce(term, F.lit(DEFAULTS["IV_Term_Structure"])).alias("IV_Term_Structure"),
        F.col("IV_ATM").alias("VIX_Proxy"),
    )


def attach_iv(bars: DataFrame, features: DataFrame) -> DataFrame:
    """IV features next to the bars, defaults where a date has no chain."""
    dated = features.withColumnRenamed("as_of", "bar_date")
    joined = bars.join(dated, ["symbol", "bar_date"], "left")
    return joined.na.fill(DEFAULTS)
