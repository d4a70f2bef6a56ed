"""Normal distribution and Black-Scholes values as Column expressions.

Spark has no error function.  The cumulative normal uses the rational
approximation of Hart (1968) in the form published by West (2005), which is
accurate to double precision.  The same coefficients serve the DuckDB text of
the correctness check and the numpy root finder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published coefficients (fixed values), highest power first.
TOP = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
    221.213596169931, 220.206867912376,
]
BOTTOM = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
    637.333633378831, 793.826512519948, 440.413735824752,
]
SWITCH = 7.07106781186547
ROOT_2PI = math.sqrt(2 * math.pi)


def _horner(x, coefficients):
    value = coefficients[0]
    for c in coefficients[1:]:
        value = value * x + c
    return value


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT_2PI


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    middle = F.exp(-a * a / 2) * _horner(a, [F.lit(c) for c in TOP]) / _horner(a, [F.lit(c) for c in BOTTOM])
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    far = F.exp(-a * a / 2) / tail / ROOT_2PI
    below = F.when(a < SWITCH, middle).when(a < 37, far).otherwise(0.0)
    return F.when(x > 0, 1 - below).otherwise(below)


def is_call(option_type: Column) -> Column:
    return F.lower(option_type).startswith("c")


def with_greeks(
    rows: DataFrame, spot: Column, strike: Column, years: Column, vol: Column, call: Column,
    rate: float = 0.05, prefix: str = "",
) -> DataFrame:
    """Add price, delta, gamma, vega (per 1 %), theta (per day) and rho (per 1 %)."""
    p = lambda name: f"{prefix}{name}"
    alive, priced = F.col("_t") > 0, (F.col("_t") > 0) & (F.col("_v") > 0)
    s, k, t, v, c = (F.col(n) for n in ("_s", "_k", "_t", "_v", "_c"))
    staged = rows.withColumns({"_s": spot, "_k": strike, "_t": years, "_v": vol, "_c": call})
    staged = staged.withColumn(
        "_d1", F.when(priced, (F.ln(s / k) + (rate + v * v / 2) * t) / (v * F.sqrt(t))).otherwise(0.0)
    )
    staged = staged.withColumn("_d2", F.col("_d1") - F.when(alive, v * F.sqrt(t)).otherwise(0.0))
    staged = staged.withColumns({
        "_n1": normal_cdf(F.col("_d1")), "_n2": normal_cdf(F.col("_d2")),
        "_f1": normal_pdf(F.col("_d1")), "_k0": k * F.exp(-rate * t),
    })
    n1, n2, f1, k0 = (F.col(n) for n in ("_n1", "_n2", "_f1", "_k0"))
    decay = -s * f1 * v / (2 * F.sqrt(t))
    zero = F.lit(0.0)
    return staged.withColumns({
        p("price"): F.when(alive, F.greatest(F.when(c, s * n1 - k0 * n2).otherwise(k0 * (1 - n2) - s * (1 - n1)), zero))
        .when(c, F.greatest(s - k, zero)).otherwise(F.greatest(k - s, zero)),
        p("delta"): F.when(alive, F.when(c, n1).otherwise(n1 - 1))
        .when(c, (s > k).cast("double")).otherwise(-(s < k).cast("double")),
        p("gamma"): F.when(priced, f1 / (s * v * F.sqrt(t))).otherwise(zero),
        p("vega"): F.when(priced, s * f1 * F.sqrt(t) / 100).otherwise(zero),
        p("theta"): F.when(alive, F.when(c, decay - rate * k0 * n2).otherwise(decay + rate * k0 * (1 - n2)) / 365).otherwise(zero),
        p("rho"): F.when(priced, F.when(c, t * k0 * n2).otherwise(-t * k0 * (1 - n2)) / 100).otherwise(zero),
    }).drop("_s", "_k", "_t", "_v", "_c", "_d1", "_d2", "_n1", "_n2", "_f1", "_k0")


def _cdf_np(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    with np.errstate(under="ignore"):
        e = np.exp(-a * a / 2)
    near = e * _horner(a, TOP) / _horner(a, BOTTOM)
    below = np.where(a < SWITCH, near, e / tail / ROOT_2PI)
    return np.where(x > 0, 1 - below, below)


def _price_np(s, k, t, r, v, call):
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    k0 = k * np.exp(-r * t)
    value = np.where(call, s * _cdf_np(d1) - k0 * _cdf_np(d2), k0 * _cdf_np(-d2) - s * _cdf_np(-d1))
    return np.maximum(value, 0.0)


# Half a unit of the fourth digit of a volatility; rise of the price over it, by spot or strike, that is only rounding.
HALF_DIGIT, FLAT = 5e-5, 1e-12


#: Volatilities between which a root is sought, and halvings of that bracket.
BRACKET, HALVINGS = (1e-6, 5.0), 60


def implied_vol(price: Column, spot: Column, strike: Column, years: Column, rate: Column, call: Column, bracket: tuple[float, float] = BRACKET) -> Column:
    """Volatility whose price is the quote; NULL when no volatility of the bracket gives it, or prices near it differ by rounding only.

    A fixed number of halvings for a whole Arrow batch at once: a fold over expressions is interpreted, node by node and row
    by row, and takes many times as long.
    """
    least, most = bracket

    @F.pandas_udf(T.DoubleType())
    def root(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series) -> pd.Series:
        q, s, k, t, r = (x.to_numpy(dtype=float, na_value=np.nan) for x in (price, spot, strike, years, rate))
        c = call.to_numpy(dtype=bool, na_value=False)
        low, high = np.full(len(q), least), np.full(len(q), most)
        with np.errstate(all="ignore"):
            possible = (t > 0) & (s > 0) & (k > 0) & (_price_np(s, k, t, r, low, c) <= q) & (q <= _price_np(s, k, t, r, high, c))
            for _ in range(HALVINGS):
                middle = (low + high) / 2
                under = _price_np(s, k, t, r, middle, c) < q
                low, high = np.where(under, middle, low), np.where(under, high, middle)
            found = np.maximum((low + high) / 2, 0.001)
            rise = _price_np(s, k, t, r, found + HALF_DIGIT, c) - _price_np(s, k, t, r, found - HALF_DIGIT, c)
            determined = rise > FLAT * np.maximum(s, k)
        return pd.Series(found).where(possible & determined, None)

    return root(price, spot, strike, years, rate, call)


# --- the same formulas as SQL text ---------------------------------------------


def cdf_sql(x: str) -> str:
    a = f"abs({x})"

    def horner(coefficients):
        text = repr(coefficients[0])
        for c in coefficients[1:]:
            text = f"({text} * {a} + {c!r})"
        return text

    tail = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k}.0 / {tail})"
    below = (
        f"CASE WHEN {a} < {SWITCH} THEN exp(-{a} * {a} / 2) * {horner(TOP)} / {horner(BOTTOM)} "
        f"WHEN {a} < 37 THEN exp(-{a} * {a} / 2) / {tail} / {ROOT_2PI!r} ELSE 0.0 END"
    )
    return f"(CASE WHEN {x} > 0 THEN 1 - ({below}) ELSE ({below}) END)"


def greeks_sql(source: str, name: str = "g", rate: float = 0.05) -> str:
    """CTEs ending in `name`: `source` has s, k, t, v, c (is call) and its own columns."""
    return f""",
{name}_d AS (SELECT *, CASE WHEN t > 0 AND v > 0 THEN (ln(s / k) + ({rate} + v * v / 2) * t) / (v * sqrt(t)) ELSE 0.0 END AS d1 FROM {source}),
{name}_e AS (SELECT *, d1 - CASE WHEN t > 0 THEN v * sqrt(t) ELSE 0.0 END AS d2 FROM {name}_d),
{name}_n AS MATERIALIZED (SELECT *, {cdf_sql('d1')} AS n1, {cdf_sql('d2')} AS n2, exp(-d1 * d1 / 2) / {ROOT_2PI!r} AS f1, k * exp(-{rate} * t) AS k0 FROM {name}_e),
{name} AS (
  SELECT *, CASE WHEN t > 0 THEN greatest(CASE WHEN c THEN s * n1 - k0 * n2 ELSE k0 * (1 - n2) - s * (1 - n1) END, 0.0)
                 WHEN c THEN greatest(s - k, 0.0) ELSE greatest(k - s, 0.0) END AS price,
         CASE WHEN t > 0 THEN CASE WHEN c THEN n1 ELSE n1 - 1 END WHEN c THEN CASE WHEN s > k THEN 1.0 ELSE 0.0 END
              ELSE CASE WHEN s < k THEN -1.0 ELSE 0.0 END END AS delta,
         CASE WHEN t > 0 AND v > 0 THEN f1 / (s * v * sqrt(t)) ELSE 0.0 END AS gamma,
         CASE WHEN t > 0 AND v > 0 THEN s * f1 * sqrt(t) / 100 ELSE 0.0 END AS vega,
         CASE WHEN t > 0 THEN (-s * f1 * v / (2 * sqrt(t)) + CASE WHEN c THEN -{rate} * k0 * n2 ELSE {rate} * k0 * (1 - n2) END) / 365 ELSE 0.0 END AS theta,
         CASE WHEN t > 0 AND v > 0 THEN CASE WHEN c THEN t * k0 * n2 ELSE -t * k0 * (1 - n2) END / 100 ELSE 0.0 END AS rho
  FROM {name}_n)
"""


def implied_vol_sql(source: str, name: str = "iv", rate: float = 0.05, bracket: tuple[float, float] = BRACKET) -> str:
    """Recursive CTEs ending in `name`: `source` has s, k, t, c (is call), q (quote) and its own columns; adds `root`.

    The WITH clause must be RECURSIVE.
    """
    low, high = bracket

    def priced(inner: str, v: str, out: str) -> str:
        value = f"greatest(CASE WHEN c THEN s * {cdf_sql('d1')} - k0 * {cdf_sql('d2')} ELSE k0 * {cdf_sql('(-d2)')} - s * {cdf_sql('(-d1)')} END, 0.0)"
        d1 = f"SELECT *, (ln(s / k) + ({rate} + {v} * {v} / 2) * t) / ({v} * sqrt(t)) AS d1, k * exp(-{rate} * t) AS k0 FROM ({inner})"
        return f"SELECT * EXCLUDE (d1, d2, k0), {value} AS {out} FROM (SELECT *, d1 - {v} * sqrt(t) AS d2 FROM ({d1}))"

    ends = priced(priced(f"SELECT *, {low}::DOUBLE AS low, {high}::DOUBLE AS high FROM {name}_n WHERE t > 0 AND s > 0 AND k > 0 AND q IS NOT NULL", "low", "p_low"), "high", "p_high")
    step = priced(f"SELECT *, (low + high) / 2 AS v FROM {name}_h WHERE i < {HALVINGS}", "v", "p")
    rise = priced(priced(f"SELECT row, s, k, t, c, root, root + {HALF_DIGIT} AS up, root - {HALF_DIGIT} AS down FROM {name}_r", "up", "p_up"), "down", "p_down")
    return f""",
{name}_n AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM {source}),
{name}_h AS (
  SELECT row, s, k, t, c, q, low, high, 0 AS i FROM ({ends}) WHERE p_low <= q AND q <= p_high
  UNION ALL
  SELECT row, s, k, t, c, q, CASE WHEN p < q THEN v ELSE low END, CASE WHEN p < q THEN high ELSE v END, i + 1 FROM ({step})),
{name}_r AS MATERIALIZED (SELECT row, s, k, t, c, greatest((low + high) / 2, 0.001) AS root FROM {name}_h WHERE i = {HALVINGS}),
{name}_d AS MATERIALIZED (SELECT row, root FROM ({rise}) WHERE p_up - p_down > {FLAT} * greatest(s, k)),
{name} AS (SELECT n.* EXCLUDE (row), d.root FROM {name}_n n LEFT JOIN {name}_d d ON d.row = n.row)
"""
