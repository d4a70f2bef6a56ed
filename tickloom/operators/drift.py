"""Drift of features, scores and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import small
from tickloom.functions.prefix import exact_percentiles
from tickloom.functions.scalars import attach_row
from tickloom.operators.frame import long_form

# Severity limits (fixed values).
PSI_MODERATE, PSI_HIGH = 0.10, 0.25
SCORE_SIGMA = 2.0
MIN_PRECISION_RATIO = 0.5
BINS = 10
_TINY = 1e-6


def psi(baseline: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    """Population stability index per feature over the deciles of both samples."""
    part = F.lit(True)
    both = long_form(baseline.withColumn("_base", part), names, ["_base"]).unionByName(
        long_form(current.withColumn("_base", ~part), names, ["_base"])
    ).filter("value IS NOT NULL")
    edges = small(exact_percentiles(both, ["feature"], "value", [i / BINS for i in range(BINS + 1)], "_edges"))
    # One row of edges per feature; a value belongs to the last bin that starts at or below it.
    bin_ = sum((F.col("value") >= F.col("_edges")[i]).cast("int") for i in range(1, BINS))
    binned = both.join(edges, "feature").withColumn("_bin", bin_)
    base = F.col("_base")
    counts = binned.groupBy("feature").agg(
        F.count_if(base).alias("_nb"), F.count_if(~base).alias("_nc"),
        *[F.count_if(base & (F.col("_bin") == i)).alias(f"_b{i}") for i in range(BINS)],
        *[F.count_if(~base & (F.col("_bin") == i)).alias(f"_c{i}") for i in range(BINS)],
    ).filter("_nb > 0 AND _nc > 0")
    terms = []
    for i in range(BINS):
        b, c = (F.col(f"_b{i}") + _TINY) / F.col("_nb"), (F.col(f"_c{i}") + _TINY) / F.col("_nc")
        terms.append((c - b) * F.ln(c / b))
    return counts.select("feature", sum(terms).alias("psi"))


def feature_drift(baseline: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    value = F.col("psi")
    severity = F.when(value > PSI_HIGH, "high").when(value > PSI_MODERATE, "moderate").otherwise("low")
    return psi(baseline, current, names).select(
        F.col("feature").alias("name"), F.lit("feature").alias("drift_type"), value.alias("value"),
        F.lit(PSI_HIGH).alias("threshold"), severity.alias("severity"), (severity != "low").alias("is_drift"),
    )


def prediction_drift(baseline: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """Shift of the mean score in baseline deviations (population)."""
    base = baseline.agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    now = current.agg(F.avg(score).alias("_c"))
    shift = F.abs(F.col("_c") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(_TINY))
    value = F.coalesce(shift, F.lit(0.0))
    severity = F.when(value > 3 * SCORE_SIGMA, "high").when(value > SCORE_SIGMA, "moderate").otherwise("low")
    return attach_row(base, now).select(
        F.lit("prediction_scores").alias("name"), F.lit("prediction").alias("drift_type"), value.alias("value"),
        F.lit(SCORE_SIGMA).alias("threshold"), severity.alias("severity"), (severity != "low").alias("is_drift"),
    )


def batch_precision(scored: DataFrame, batch: Column, keys: list[str]) -> DataFrame:
    hit = F.count_if(F.col("pred") & (F.col("label") == 1))
    return scored.groupBy(*keys, batch.alias("batch")).agg(
        F.coalesce(F.try_divide(hit, F.count_if("pred")), F.lit(0.0)).alias("precision")
    )


def performance_drift(batches: DataFrame, baseline_precision: float, keys: list[str], window: int = 3) -> DataFrame:
    """Degraded batches among the last three; the input has one row per batch."""
    limit = baseline_precision * MIN_PRECISION_RATIO
    recent = Window.partitionBy(*keys).orderBy("batch").rowsBetween(-(window - 1), 0)
    marked = batches.withColumn("degraded", F.sum((F.col("precision") < limit).cast("int")).over(recent))
    severity = F.when(F.col("degraded") >= window, "high").when(F.col("degraded") >= 2, "moderate").otherwise("low")
    return marked.select(
        *keys, "batch", F.col("precision").alias("value"), F.lit(limit).alias("threshold"),
        F.col("degraded").cast("int").alias("degraded"), severity.alias("severity"), (severity != "low").alias("is_drift"),
    )


def overall_status(results: DataFrame) -> DataFrame:
    """alert, caution or healthy from all drift results."""
    rank = F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "moderate", 1).otherwise(0))
    status = F.when(rank == 2, "alert").when(rank == 1, "caution").otherwise("healthy")
    return results.agg(
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "moderate").alias("moderate"), status.alias("overall_status"),
    )


def mean_shift(train: DataFrame, test: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """Mean shifts in train deviations, the largest first; `top` cuts the list for a report."""
    rows = long_form(train.withColumn("_train", F.lit(True)), names, ["_train"]).unionByName(
        long_form(test.withColumn("_train", F.lit(False)), names, ["_train"])
    )
    is_train = F.col("_train")
    stats = rows.groupBy("feature").agg(
        F.avg(F.when(is_train, F.col("value"))).alias("train_mean"),
        F.avg(F.when(~is_train, F.col("value"))).alias("test_mean"),
        F.stddev_samp(F.when(is_train, F.col("value"))).alias("_std"),
    )
    shift = F.try_divide(F.abs(F.col("test_mean") - F.col("train_mean")), F.col("_std"))
    ordered = stats.withColumn("shift", shift).drop("_std").orderBy(F.desc_nulls_last("shift"), "feature")
    return ordered if top is None else ordered.limit(top)
