"""Streaming bars with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, interval: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """OHLCV bars from (symbol, ts, price) ticks, emitted once the watermark passes the bar.

    Of ticks with one time the lowest price opens and the highest closes.  The state is one partial aggregate per open bar, combined map-side.
    """
    stamped = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return stamped.groupBy("symbol", F.window("ts", interval).alias("w")).agg(
        F.min_by(F.col("price"), F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by(F.col("price"), F.struct("ts", "price")).alias("close"), F.count("*").cast("double").alias("volume"),
    ).select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
