"""Walk-forward windows, fold assignment and holdout splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import small


def walk_forward_windows(bounds: DataFrame, train_years: int = 3, test_years: int = 1, step_years: int = 1) -> DataFrame:
    """Expanding train windows from a one-row table (first_date, last_date).

    Fold k tests the years after train + k * step; incomplete tests are left out.
    """
    spare = F.year("last_date") - F.year("first_date") - train_years
    steps = F.greatest(F.floor(spare / step_years), F.lit(0))
    shifted = bounds.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))))
    start_month = 12 * (train_years + F.col("k") * step_years)
    dated = shifted.select(
        (F.col("k") + 1).cast("int").alias("fold_id"),
        F.col("first_date").alias("train_start"),
        F.add_months("first_date", start_month.cast("int")).alias("test_start"),
        F.add_months("first_date", (start_month + 12 * test_years).cast("int")).alias("_next"),
        "last_date",
    )
    return dated.select(
        "fold_id", "train_start", F.date_sub("test_start", 1).alias("train_end"),
        "test_start", F.date_sub("_next", 1).alias("test_end"), "last_date",
    ).filter("test_end <= last_date").drop("last_date")


def date_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"))


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """One copy of a row per fold it belongs to, with `split` train or test.

    The fold table holds one row per test period (years, so at most some
    hundreds), which is why this range join can broadcast it.
    """
    day = F.col("bar_date")
    inside = (day >= F.col("train_start")) & (day <= F.col("test_end"))
    joined = rows.join(F.broadcast(folds), inside)
    split = F.when(day <= F.col("train_end"), "train").when(day >= F.col("test_start"), "test")
    return joined.withColumn("split", split).select(*rows.columns, "fold_id", "split")


def keep_large_folds(assigned: DataFrame, min_train: int = 100, min_test: int = 50, keys: tuple[str, ...] = ("fold_id",)) -> DataFrame:
    """Drop folds with too few train or test rows."""
    sizes = assigned.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    large = sizes.filter((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    return assigned.join(small(large.select(*keys)), list(keys), "left_semi")


def holdout_split(rows: DataFrame, train_end, test_end) -> DataFrame:
    """Fixed dates: train up to train_end, test up to test_end, later rows dropped."""
    day, first, last = F.col("bar_date"), _date(train_end), _date(test_end)
    return rows.filter(day <= last).withColumn("split", F.when(day <= first, "train").otherwise("test"))


def _date(value) -> Column:
    return F.lit(value).cast("date")
