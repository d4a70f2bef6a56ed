"""Result files of earlier runs: alerts, fold metrics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names found in result files (fixed values).
METRIC_NAMES = {
    "Model": "model", "Period": "fold_id", "Horizon": "horizon", "F1": "f1", "PR AUC": "pr_auc",
    "PR_AUC": "pr_auc", "Brier": "brier", "Brier Score": "brier", "Baseline F1": "baseline_f1",
    "Precision@5%": "precision_at_5pct", "Positive Rate": "positive_rate",
}


def load_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts with a `Date` header, or `level_0` as written by index exports."""
    return normalize_alerts(spark.read.option("header", True).csv(path))


def normalize_alerts(raw: DataFrame) -> DataFrame:
    renamed = raw.withColumnsRenamed({"level_0": "Date", "level_1": "Ticker"})
    missing = [c for c in ("Date", "Ticker", "Score") if c not in renamed.columns]
    if missing:
        raise ValueError(f"alerts lack {missing}")
    return renamed.withColumns(
        {"Date": F.to_date("Date"), "Score": F.col("Score").try_cast("double")}
    ).withColumnsRenamed({"Date": "bar_date", "Ticker": "symbol", "Score": "score"})


def number_or_percent(text: Column) -> Column:
    """`12.3%` to 0.123, `0.5` to 0.5, anything else to NULL."""
    number = F.regexp_replace(F.trim(text), "%$", "").try_cast("double")
    return F.when(F.trim(text).endswith("%"), number / 100).otherwise(number)


def load_result_metrics(spark: SparkSession, path: str) -> DataFrame:
    return normalize_metrics(spark.read.option("header", True).csv(path))


def normalize_metrics(raw: DataFrame) -> DataFrame:
    table = raw.withColumnsRenamed(METRIC_NAMES)
    numeric = [c for c in table.columns if c in set(METRIC_NAMES.values()) - {"model"}]
    return table.withColumns({c: number_or_percent(F.col(c)) for c in numeric})


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A (nested) report table as JSON lines."""
    report.write.mode(mode).json(path)
