"""Data-quality checks of a bar table as one long-form report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.blocks import gather, rolling, spread
from tickloom.functions.rolling import series
from tickloom.operators.technical import returns
from tickloom.schemas import PRICE_COLUMNS

# Limits of the checks (fixed values).
MIN_ROWS = 1000
MAX_MISSING = 0.05
MAX_MOVE = 0.30
LEVELS = ["ok", "warning", "error"]


def require_columns(bars: DataFrame, columns=PRICE_COLUMNS) -> None:
    missing = sorted(set(columns) - set(bars.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def column_report(bars: DataFrame, columns=PRICE_COLUMNS) -> DataFrame:
    """Presence of every required column and the rows that have it, per symbol."""
    found = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in bars.columns).alias("present")) for c in columns])
    counts = bars.groupBy("symbol").agg(F.count("*").alias("_n")).select("symbol", "_n", F.explode(found).alias("f"))
    return counts.select(
        "symbol", "f.column_name", "f.present", F.when(F.col("f.present"), F.col("_n")).otherwise(F.lit(0)).alias("rows")
    )


def row_counts(bars: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("rows")).withColumn(
        "too_few", F.col("rows") < minimum
    )


def out_of_order(bars: DataFrame, arrival: str, time: str = "bar_date") -> DataFrame:
    """Rows whose time is before that of the row that arrived just before them.

    Tables have no order, so the arrival key (a number) says what came first.
    """
    laid_out = spread(bars.withColumn("_arrival", F.timestamp_seconds(arrival)), 1, order="_arrival")
    before = F.lag(time).over(series("_arrival"))
    flagged = gather(laid_out.withColumn("_late", F.coalesce(F.col(time) < before, F.lit(False))))
    return flagged.groupBy("symbol").agg(F.count_if("_late").alias("out_of_order"))


def duplicate_dates(bars: DataFrame) -> DataFrame:
    """Rows beyond the first of each date; counted per date first, so no set is kept."""
    dates = bars.groupBy("symbol", "bar_date").agg(F.count("*").alias("_n"))
    return dates.groupBy("symbol").agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def missing_fraction(bars: DataFrame) -> DataFrame:
    nulls = sum(F.col(c).isNull().cast("int") for c in PRICE_COLUMNS)
    return bars.groupBy("symbol").agg(
        F.sum(nulls).alias("missing"),
        (F.sum(nulls) / (F.count("*") * len(PRICE_COLUMNS))).alias("missing_fraction"),
    )


def value_checks(bars: DataFrame) -> DataFrame:
    """Non-positive closes and inverted highs and lows."""
    return bars.groupBy("symbol").agg(
        F.count_if(F.col("close") <= 0).alias("nonpositive_close"),
        F.count_if(F.col("high") < F.col("low")).alias("inverted"),
    )


def extreme_moves(bars: DataFrame, limit: float = MAX_MOVE) -> DataFrame:
    moved = returns(bars)
    return moved.groupBy("symbol").agg(F.count_if(F.abs("returns") > limit).alias("extreme_moves"))


@rolling(lookback=1)
def _with_move(bars: DataFrame) -> DataFrame:
    return returns(bars)


def validation_report(bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """(symbol, check, value, level): errors fail a symbol, warnings do not.

    A table without a required column fails every symbol: `missing_columns` counts them, and what needs them counts them
    as null.  `arrival` names the number that says in which order rows came; rows out of time order then fail a symbol.

    Dates are compared per (symbol, date) first; everything else is one
    aggregate over the bars.
    """
    absent = [c for c in PRICE_COLUMNS if c not in bars.columns]
    bars = bars.withColumns({c: F.lit(None).cast("double") for c in absent})
    nulls = sum(F.col(c).isNull().cast("int") for c in PRICE_COLUMNS)
    stats = _with_move(bars).groupBy("symbol").agg(
        F.count("*").cast("double").alias("rows"),
        (F.sum(nulls) / (F.count("*") * len(PRICE_COLUMNS))).alias("missing_fraction"),
        F.count_if(F.col("close") <= 0).cast("double").alias("nonpositive_close"),
        F.count_if(F.col("high") < F.col("low")).cast("double").alias("inverted"),
        F.count_if(F.abs("returns") > MAX_MOVE).cast("double").alias("extreme_moves"),
    ).join(duplicate_dates(bars).withColumn("duplicates", F.col("duplicates").cast("double")), "symbol")
    stats = stats.withColumn("missing_columns", F.lit(float(len(absent))))
    checks = ["rows", "missing_fraction", "nonpositive_close", "inverted", "extreme_moves", "duplicates", "missing_columns"]
    if arrival is not None:
        late = out_of_order(bars, arrival).withColumn("out_of_order", F.col("out_of_order").cast("double"))
        stats, checks = stats.join(late, "symbol"), [*checks, "out_of_order"]
    value, check = F.col("value"), F.col("check")
    failed = (
        ((check == "rows") & (value < MIN_ROWS))
        | ((check == "missing_fraction") & (value > MAX_MISSING))
        | (check.isin("nonpositive_close", "duplicates", "missing_columns", "out_of_order") & (value > 0))
    )
    warned = check.isin("missing_fraction", "inverted", "extreme_moves") & (value > 0)
    return stats.unpivot(["symbol"], checks, "check", "value").withColumn(
        "level", F.when(failed, "error").when(warned, "warning").otherwise("ok")
    )


def verdict(report: DataFrame) -> DataFrame:
    """Worst level per symbol, and whether the symbol passes."""
    rank = F.max(F.array_position(F.array(*[F.lit(l) for l in LEVELS]), F.col("level")))
    return report.groupBy("symbol").agg(
        F.element_at(F.array(*[F.lit(l) for l in LEVELS]), rank.cast("int")).alias("worst"),
        (rank < len(LEVELS)).alias("passed"),
    )
