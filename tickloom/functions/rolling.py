"""Column helpers for rolling windows over a laid-out series."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("symbol", "block")


def series(order: str = "bar_date") -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy(order)


def rows(first: int, last: int = 0, order: str = "bar_date") -> WindowSpec:
    return series(order).rowsBetween(first, last)


def last_n(n: int, order: str = "bar_date") -> WindowSpec:
    return rows(-(n - 1), 0, order)


def full(value: Column, over: WindowSpec, n: int, result: Column) -> Column:
    """`result`, or NULL unless the frame holds n known values."""
    return F.when(F.count(value).over(over) >= n, result)


def mean_n(value: Column, n: int, order: str = "bar_date") -> Column:
    w = last_n(n, order)
    return full(value, w, n, F.avg(value).over(w))


def std_n(value: Column, n: int, order: str = "bar_date") -> Column:
    w = last_n(n, order)
    return full(value, w, n, F.stddev_samp(value).over(w))


def max_n(value: Column, n: int) -> Column:
    w = last_n(n)
    return full(value, w, n, F.max(value).over(w))


def min_n(value: Column, n: int) -> Column:
    w = last_n(n)
    return full(value, w, n, F.min(value).over(w))


def lag(value: Column, n: int = 1, order: str = "bar_date") -> Column:
    return F.lag(value, n).over(series(order))


def lead(value: Column, n: int = 1) -> Column:
    return F.lead(value, n).over(series())


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def quantile_of_sorted(ordered: Column, p: float, n: int) -> Column:
    """Linear-interpolated quantile of a sorted array of known length n."""
    at = (n - 1) * p
    low, part = int(at), at - int(at)
    base = F.get(ordered, F.lit(low))
    return base if part == 0 else base + (F.get(ordered, F.lit(low + 1)) - base) * F.lit(part)
