"""Walk-forward scoring, final models and coefficient tables on Spark ML.

Spark ML trains each model as distributed jobs over the rows.  Walk-forward folds are a short list (one per test
year); their fits are independent jobs and run side by side, never over rows on the driver.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut
from tickloom.functions.parallel import side_by_side
from tickloom.operators.calibrated import CALIBRATION_FOLDS, PARTITION_ROWS, CalibratedClassifier, CalibratedModel, fit_base, fit_parts
from tickloom.operators.evaluate import optimize_threshold
from tickloom.operators.frame import apply_scaler, fit_scaler
from tickloom.operators.weights import WEIGHTS, class_weights, make_model  # noqa: F401

_OUTPUTS = ("rawPrediction", "probability", "prediction")
#: Folds that are fitted at once; each of them fits its base models at once.
FOLDS_AT_ONCE = 3


def assemble(rows: DataFrame, names: list[str]) -> DataFrame:
    """Feature vector; a missing feature is an error."""
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(rows)


def _probability(name: str = "probability") -> Column:
    return vector_to_array(F.col(name))[1]


def fit_calibrated(train: DataFrame, kind: str, rounds: int = 300, parts: int = CALIBRATION_FOLDS) -> CalibratedModel:
    """A calibrated model of rows that hold their vector `features`, without a scaler."""
    return fit_parts(CalibratedModel(kind), train, rounds, parts, parts)


def fit_folds(assigned: DataFrame, fold_ids: list[int], names: list[str], kind: str, rounds: int = 300) -> dict[int, CalibratedModel]:
    """A calibrated model for the train rows of every fold."""
    spark = assigned.sparkSession
    estimator = CalibratedClassifier(names, kind, rounds)

    def fit(fold: int) -> CalibratedModel:
        return estimator.fit(assigned.filter((F.col("fold_id") == fold) & (F.col("split") == "train")))

    return dict(zip(fold_ids, side_by_side(spark, [lambda f=f: fit(f) for f in fold_ids], FOLDS_AT_ONCE, "fold")))


def score_folds(assigned: DataFrame, fitted: dict[int, CalibratedModel], names: list[str], kind: str) -> DataFrame:
    """Every fold's train and test rows with the score of the fold's model."""
    parts = [model.transform(assigned.filter(F.col("fold_id") == fold)) for fold, model in fitted.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.drop(*names).withColumn("model", F.lit(kind))


def walk_forward_scores(
    assigned: DataFrame, fold_ids: list[int], names: list[str], kind: str, rounds: int = 300, calibrate: bool = True
) -> DataFrame:
    """Scores of every fold's train and test rows.

    `assigned` has (symbol, bar_date, label, features..., fold_id, split) with complete rows.  Scaler, base models and
    sigmoids are fitted on train rows only.
    """
    if calibrate:
        return score_folds(assigned, fit_folds(assigned, fold_ids, names, kind, rounds), names, kind)
    scaled = apply_scaler(assigned, fit_scaler(assigned.filter("split = 'train'"), names), names)
    vectors = cut(assemble(scaled, names)).drop(*names)

    def score(fold: int) -> DataFrame:
        rows = vectors.filter(F.col("fold_id") == fold)
        train = rows.filter("split = 'train'")
        train = train.coalesce(max(1, math.ceil(train.count() / PARTITION_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
        base = fit_base(train, kind, rounds)
        train.unpersist()
        return base.transform(rows).withColumn("score", _probability()).drop(*_OUTPUTS, "features")

    parts = side_by_side(assigned.sparkSession, [lambda f=f: score(f) for f in fold_ids], FOLDS_AT_ONCE, "fold")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("model", F.lit(kind))


def with_decisions(scored: DataFrame) -> DataFrame:
    """Test rows with predictions at the threshold found on the fold's train rows."""
    scored = cut(scored)
    thresholds = optimize_threshold(scored.filter("split = 'train'"), ["model", "fold_id"]).drop("f_beta")
    test = scored.filter("split = 'test'").join(thresholds, ["model", "fold_id"])
    return test.withColumn("pred", F.col("score") >= F.col("threshold"))


def coefficients(models: dict[int, CalibratedModel], spark) -> DataFrame:
    """(fold_id, feature, coefficient): mean over the base models of each fold; one short list per fold."""
    rows = [(fold, name, value) for fold, m in models.items() for name, value in m.coefficients().items()]
    return spark.createDataFrame(rows, "fold_id int, feature string, coefficient double")


def coefficient_stability(table: DataFrame) -> DataFrame:
    """Mean, mean magnitude, population deviation and share of positive signs over folds."""
    c = F.col("coefficient")
    return table.groupBy("feature").agg(
        F.avg(c).alias("mean"), F.avg(F.abs(c)).alias("mean_abs"), F.stddev_pop(c).alias("std"),
        F.avg((c > 0).cast("double")).alias("positive_fraction"),
    ).orderBy(F.desc("mean_abs"), "feature")


def fit_final(rows: DataFrame, names: list[str], kind: str, path: str | None = None, rounds: int = 300) -> CalibratedModel:
    """Scaler, base models and sigmoids on all complete rows; saved as one model when a path is given."""
    model = CalibratedClassifier(names, kind, rounds).fit(rows)
    if path:
        model.write().overwrite().save(path)
    return model


def score_batch(model: CalibratedModel, rows: DataFrame) -> DataFrame:
    """Probability of the positive class; works on tables and on streams.

    Rows with a missing feature are an error, as is a missing column.
    """
    return model.transform(rows)
