"""Row blocks with overlap: rolling windows that do not need a whole series.

A rolling window looks back a known number of rows.  `spread` numbers the rows
of each series, cuts the series into blocks and copies to every block the rows
just before (and, for forward labels, just after) it.  Windows partitioned by
(series, block) then give the same values as windows over the whole series,
and a series of any length is processed by many tasks.  `gather` keeps each
row once, in its home block.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.prefix import number_rows

BLOCK_ROWS = 2048
_LAYOUT = ["rn", "block", "home"]


def time_bucket(df: DataFrame, order: str) -> Column:
    """Calendar bucket used for numbering: years for dates, days for timestamps."""
    kind = dict(df.dtypes)[order]
    return F.year(order) if kind == "date" else F.to_date(order)


def spread(
    bars: DataFrame,
    lookback: int = 0,
    lookahead: int = 0,
    keys: tuple[str, ...] = ("symbol",),
    order: str = "bar_date",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    numbered = number_rows(bars, list(keys), time_bucket(bars, order), [F.col(order)])
    at = F.col("rn") - 1
    first = F.floor(F.greatest(at - lookahead, F.lit(0)) / block_rows)
    last = F.floor((at + lookback) / block_rows)
    return numbered.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "home", F.col("block") == F.floor(at / block_rows)
    )


def gather(df: DataFrame) -> DataFrame:
    return df.filter("home").drop(*_LAYOUT)


def rolling(lookback: int | Callable, lookahead: int | Callable = 0, order: str = "bar_date"):
    """Let a window operator run on plain bars or inside a caller's layout.

    The wrapped function must use windows over (symbol, block).  `lookback`
    and `lookahead` are row counts, or functions of the call's parameters.
    """

    def wrap(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(bars: DataFrame, *args, **kwargs) -> DataFrame:
            if "block" in bars.columns:
                return operator(bars, *args, **kwargs)
            bound = signature.bind(bars, *args, **kwargs)
            bound.apply_defaults()
            rows = [n(bound.arguments) if callable(n) else n for n in (lookback, lookahead)]
            laid_out = spread(bars, rows[0], rows[1], order=order)
            return gather(operator(laid_out, *args, **kwargs))

        return run

    return wrap
