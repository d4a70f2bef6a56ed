"""Bar sources: bar tables, wide vendor tables, trades, and the table sink."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas


def load_bars(
    spark: SparkSession, path: str, symbols: list[str] | None = None,
    start: date | str | None = None, end: date | str | None = None, fmt: str = "parquet",
) -> DataFrame:
    """One or many symbols of a bar table; the filters reach the scan.

    An empty result is an error.
    """
    reader = spark.read.schema(schemas.BARS)
    if fmt == "csv":
        reader = reader.option("header", True)
    bars = select_bars(reader.format(fmt).load(path), symbols, start, end)
    if bars.isEmpty():
        raise ValueError(f"no bars for {symbols or 'any symbol'} in {path}")
    return bars


def select_bars(bars: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
    if symbols:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    if start is not None:
        bars = bars.filter(F.col("bar_date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("bar_date") <= F.lit(end).cast("date"))
    return bars


def normalize_columns(wide: DataFrame, date_column: str = "Date") -> DataFrame:
    """Vendor headers `Field` or `Field|SYMBOL` to (symbol, bar_date, open, ...).

    Several symbols in one wide table become rows.
    """
    fields = {"open", "high", "low", "close", "volume"}
    pairs = {}
    for name in wide.columns:
        field, _, symbol = name.partition("|")
        if field.lower() in fields:
            pairs.setdefault(symbol, {})[field.lower()] = name
    for symbol, found in pairs.items():
        if set(found) != fields:
            raise ValueError(f"{symbol or 'table'} lacks {sorted(fields - set(found))}")
    records = F.array(*[
        F.struct(
            F.lit(symbol).alias("symbol"),
            *[F.col(f"`{found[f]}`").cast("double").alias(f) for f in schemas.PRICE_COLUMNS],
        )
        for symbol, found in pairs.items()
    ])
    return wide.select(
        F.col(f"`{date_column}`").cast("date").alias("bar_date"), F.explode(records).alias("r")
    ).select("r.symbol", "bar_date", *[f"r.{c}" for c in schemas.PRICE_COLUMNS])


def trades_to_bars(
    trades: DataFrame, symbol: Column, bucket: Column, price: Column, sequence: Column,
    volume: Column, time: str = "bar_date",
) -> DataFrame:
    """OHLCV bars per (symbol, bucket); all parts combine map-side.

    Of trades with one sequence the lowest price opens and the highest closes.
    """
    ticks = trades.select(
        symbol.alias("symbol"), bucket.alias(time), price.alias("_p"), sequence.alias("_seq"),
        volume.alias("_v"),
    )
    return ticks.groupBy("symbol", time).agg(
        F.min_by(F.col("_p"), F.struct("_seq", "_p")).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by(F.col("_p"), F.struct("_seq", "_p")).alias("close"), F.sum("_v").alias("volume"),
    )


def interval_bars(
    trades: DataFrame, interval: str = "5 minutes", symbol: str = "symbol", ts: str = "ts",
    price: str = "price", volume: Column | None = None,
) -> DataFrame:
    """Intraday bars of a fixed interval, keyed by `bar_start`."""
    stamped = trades.withColumn("_ts", F.col(ts).cast("timestamp"))
    return trades_to_bars(
        stamped, F.col(symbol), F.window("_ts", interval)["start"], F.col(price), F.col("_ts"),
        F.lit(1.0) if volume is None else volume, time="bar_start",
    )


def load_intraday(spark: SparkSession, path: str, interval: str = "5 minutes", **columns) -> DataFrame:
    """Bars of a stored trade table; an empty one is an error."""
    trades = spark.read.parquet(path)
    if trades.isEmpty():
        raise ValueError(f"no trades in {path}")
    return interval_bars(trades, interval, **columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
