"""Streaming performance drift: the last three batch precisions per model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.operators.drift import MIN_PRECISION_RATIO

OUTPUT = "model string, batch date, value double, degraded int, severity string"
STATE = "recent array<double>"


def batch_counts(scored: DataFrame, days: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """Predictions and hits per model and time window of a scored stream.

    This aggregate combines map-side, so a busy model costs the stateful step
    below one row per window only.
    """
    stamped = scored.withColumn("at", F.col("bar_date").cast("timestamp")).withWatermark("at", lateness)
    return stamped.groupBy("model", F.window("at", days).alias("w")).agg(
        F.count_if("pred").alias("predicted"), F.count_if(F.col("pred") & (F.col("label") == 1)).alias("hits"),
    ).select("model", F.col("w.start").alias("batch"), "predicted", "hits")


def performance_drift(batches: DataFrame, baseline_precision: float, window: int = 3) -> DataFrame:
    """(model, batch, predicted, hits) rows to drift results; the state is `window` numbers per model."""
    limit = baseline_precision * MIN_PRECISION_RATIO

    def update(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("batch")
        recent = list(state.get[0]) if state.exists else []
        out = []
        for batch, predicted, hits in zip(rows["batch"], rows["predicted"], rows["hits"]):
            value = float(hits) / float(predicted) if predicted else 0.0
            recent = (recent + [value])[-window:]
            bad = sum(v < limit for v in recent)
            severity = "high" if bad >= window else "moderate" if bad >= 2 else "low"
            out.append((key[0], pd.Timestamp(batch).date(), value, bad, severity))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["model", "batch", "value", "degraded", "severity"])

    return batches.groupBy("model").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
