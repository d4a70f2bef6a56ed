"""Class weights and base estimators of the model kinds."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import small
from tickloom.functions.scalars import attach_row

# Seed (fixed value).
SEED = 42
# Weighting of each model kind (fixed choice).
WEIGHTS = {"logistic": "balanced", "random_forest": "balanced", "boosted_a": "fixed", "boosted_b": "imbalance"}


def class_weights(rows: DataFrame, label: str, kind: str = "balanced", keys: list[str] | None = None, out: str = "weight") -> DataFrame:
    """balanced: n / (2 n_class); fixed: 20 for positives; imbalance: n_neg / n_pos for positives."""
    positive = F.col(label) == 1
    if kind == "fixed":
        return rows.withColumn(out, F.when(positive, 20.0).otherwise(1.0))
    keys = keys or []
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p")
    )
    joined = rows.join(small(counts), keys) if keys else attach_row(rows, counts)
    n, p = F.col("_n"), F.col("_p")
    if kind == "balanced":
        weight = F.when(positive, F.try_divide(n, 2 * p)).otherwise(F.try_divide(n, 2 * (n - p)))
    elif kind == "imbalance":
        weight = F.when(positive, F.try_divide(n - p, p)).otherwise(1.0)
    else:
        raise ValueError(f"unknown weights {kind!r}")
    return joined.withColumn(out, weight).drop("_n", "_p")


def make_model(kind: str, n_rows: int, rounds: int = 300):
    """Estimator of a kind.  `rounds` shortens boosting, which Spark ML runs one tree after another."""
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    if kind == "logistic":
        # C = 1 with weights that sum to n is a penalty of 1/n per unit weight.
        return LogisticRegression(
            regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False, maxIter=1000,
            **common,
        )
    if kind == "random_forest":
        return RandomForestClassifier(
            numTrees=200, maxDepth=6, minInstancesPerNode=10, seed=SEED, **common
        )
    if kind in ("boosted_a", "boosted_b"):
        return GBTClassifier(
            maxIter=rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
            **common,
        )
    raise ValueError(f"unknown model {kind!r}")
