"""Queries over the whole option chain."""

import math

import compare
import pytest

from tickloom.operators import options
from tickloom.plans import views
from tickloom.plans.catalog import ORACLE, QUERIES


def brute_price(r, v):
    t = (r.expiration_date - r.as_of).days / 365.0
    d1 = (math.log(r.spot / r.strike) + (0.05 + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    cdf, k0 = lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), r.strike * math.exp(-0.05 * t)
    return r.spot * cdf(d1) - k0 * cdf(d2) if r.option_type == "call" else k0 * cdf(-d2) - r.spot * cdf(-d1)


def test_every_contract_is_solved_or_null(spark, sf):
    key = lambda r: (r.symbol, r.as_of, r.expiration_date, r.strike, r.option_type)
    chain = {key(r): r for r in views.chain(spark, sf).collect()}
    got = {key(r): r.bs_iv for r in QUERIES["implied_vol_chain"](spark, sf).collect()}
    assert got.keys() == chain.keys()
    solved = [k for k in got if got[k] is not None]
    assert all(abs(got[k] - chain[k].implied_volatility) < 1e-4 for k in solved)
    for k in got.keys() - set(solved):
        r = chain[k]
        rise = brute_price(r, r.implied_volatility + 5e-5) - brute_price(r, r.implied_volatility - 5e-5)
        assert rise < 2e-12 * max(r.spot, r.strike)
    assert len(solved) > QUERIES["implied_vol"](spark, sf).count() and len(solved) < len(got)


def test_undetermined_quotes_are_null(spark):
    row = "X", 100.0, 500.0, 0.02, "call", 0.0
    quote = spark.createDataFrame([row], "symbol string, spot double, strike double, years double, option_type string, price double")
    assert options.with_implied_vol(quote, quote.price, years=quote.years).first().bs_iv is None


@pytest.mark.parametrize("name", ["portfolio_greeks_chain", "vega_hedge_by_expiry"])
def test_whole_chain_sums_and_hedges(spark, sf, name):
    assert compare.compare(spark, compare.connect(sf), name, QUERIES[name], ORACLE[name], sf) == ""
