"""Cleaning of raw bars, in the order of `clean`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.blocks import time_bucket
from tickloom.schemas import PRICE_COLUMNS


def coerce_numeric(bars: DataFrame, columns=PRICE_COLUMNS) -> DataFrame:
    """Text that is not a number becomes NULL."""
    return bars.withColumns({c: F.col(c).try_cast("double") for c in columns})


def fix_high_low(bars: DataFrame) -> DataFrame:
    """Swap inverted highs and lows; an unknown side takes the known one."""
    return bars.withColumns({"high": F.greatest("high", "low"), "low": F.least("high", "low")})


def forward_fill(
    bars: DataFrame, columns=PRICE_COLUMNS, keys: tuple[str, ...] = ("symbol",), order: str = "bar_date",
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """Carry the last known value of each column forward; never backward.

    A gap has no length limit, so the fill runs inside calendar buckets and
    the last known value of all earlier buckets comes from a per-bucket table.
    `tie` orders rows that share the same key and time.
    """
    bucketed = bars.withColumn("_bucket", time_bucket(bars, order))
    at = F.struct(order, *tie)
    latest = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = latest.select(
        *keys, "_bucket", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns]
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = bucketed.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    return local.join(carry, [*keys, "_bucket"]).select(*[
        F.coalesce(c, f"_c_{c}").alias(c) if c in columns else F.col(c) for c in bars.columns
    ])


def drop_incomplete(bars: DataFrame, columns=PRICE_COLUMNS) -> DataFrame:
    """Rows still unknown after the fill (the start of a series)."""
    return bars.na.drop(subset=list(columns))


def drop_zero_volume(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("volume") > 0)


def clean(bars: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Coerce, fix highs and lows, fill forward, drop unknown and untraded rows."""
    filled = forward_fill(fix_high_low(coerce_numeric(bars)), tie=tie)
    return drop_zero_volume(drop_incomplete(filled))
