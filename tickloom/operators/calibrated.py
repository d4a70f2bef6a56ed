"""Scaler, base models and sigmoids as one Spark ML estimator and one model that is saved whole.

`CalibratedClassifier` fits the scaler on the complete rows, cuts them into consecutive parts of each class in date
order, and for every part fits a base model on the other parts and a sigmoid on the part left out.  The fits are
independent jobs and run side by side.  `CalibratedModel` scores tables and streams from raw features; its score is the
mean of the calibrated probabilities.  Both are plain pipeline stages.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.lineage import checkpointed, cut, remove, shared_folder, small
from tickloom.functions.parallel import side_by_side
from tickloom.functions.prefix import number_rows
from tickloom.functions.scalars import attach_row
from tickloom.operators.frame import fit_scaler
from tickloom.operators.weights import WEIGHTS, class_weights, make_model

CALIBRATION_FOLDS = 3
#: Rows of a partition of training rows: each of a fit's many small jobs runs one task per partition.
PARTITION_ROWS = 100_000
_OUTPUTS = ("rawPrediction", "probability", "prediction")


def margin(scored: DataFrame, out: str) -> DataFrame:
    """The model's raw value for the positive class; other outputs are dropped."""
    return scored.withColumn(out, vector_to_array(F.col("rawPrediction"))[1]).drop(*_OUTPUTS)


def inner_folds(train: DataFrame, parts: int = CALIBRATION_FOLDS) -> DataFrame:
    """Consecutive parts of equal size of each class, in date order.

    Buckets are dates: a class may hold nearly all rows, a date only one row per symbol.
    """
    numbered = number_rows(train, ["label"], F.col("bar_date"), [F.col("bar_date"), F.col("symbol")], "_at")
    sizes = train.groupBy("label").agg(F.count("*").alias("_n"))
    part = F.floor((F.col("_at") - 1) * parts / F.col("_n")).cast("int")
    return numbered.join(small(sizes), "label").withColumn("_part", part).drop("_at", "_n")


def without_summary(model, spark: SparkSession):
    """The same model without its training summary.

    A summary holds the session and travels with the model to the tasks that score; a session that has observed a table
    (`DataFrame.observe`) cannot be serialised.  Saved models have no summary.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{shared_folder(spark)}/base-{uuid.uuid4().hex}"
    model.write().save(path)
    loaded = type(model).load(path)
    remove(spark, [path])
    return loaded


def fit_base(train: DataFrame, kind: str, rounds: int = 300):
    """Fit on (features, label) rows with the weights of the kind."""
    weighted = class_weights(train, "label", WEIGHTS[kind])
    fitted = make_model(kind, weighted.count() if kind == "logistic" else 0, rounds).fit(weighted)
    return without_summary(fitted, train.sparkSession)


def fit_sigmoid(held: DataFrame) -> tuple[float, float]:
    """Slope and shift of a logistic regression on the margin with smoothed targets.

    Every row enters as a positive and a negative with the target as weight.
    """
    counts = held.agg(F.sum(F.col("label").cast("double")).alias("_p"), F.count("*").alias("_n"))
    target = F.when(F.col("label") == 1, (F.col("_p") + 1) / (F.col("_p") + 2)).otherwise(1 / (F.col("_n") - F.col("_p") + 2))
    pairs = attach_row(held, counts).select(
        F.col("margin"),
        F.explode(F.array(
            F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))
        )).alias("t"),
    ).select("margin", F.col("t.y").alias("y"), F.col("t.w").alias("w"))
    vectors = VectorAssembler(inputCols=["margin"], outputCol="x").transform(pairs)
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, maxIter=100).fit(vectors)
    return float(fitted.coefficients[0]), float(fitted.intercept)


class CalibratedModel(Model, MLWritable, MLReadable):
    """Scaled features, base models with one sigmoid each; the score is the mean of their probabilities.

    Without names the rows already hold their vector `features`.  A missing feature is an error, as is a missing column.
    """

    def __init__(self, kind: str = "", names=(), means=(), deviations=(), bases=(), sigmoids=()):
        super().__init__()
        self.kind, self.names = kind, list(names)
        self.means, self.deviations = list(means), list(deviations)
        self.bases, self.sigmoids = list(bases), [tuple(s) for s in sigmoids]

    def scaled(self, rows: DataFrame) -> DataFrame:
        """Feature vector of scaled columns beside the given ones."""
        values = [((F.col(n) - F.lit(m)) / F.lit(d)).alias(f"_x{i}") for i, (n, m, d) in enumerate(zip(self.names, self.means, self.deviations))]
        own = [f"_x{i}" for i in range(len(values))]
        wide = VectorAssembler(inputCols=own, outputCol="features", handleInvalid="error").transform(rows.select("*", *values))
        return wide.drop(*own)

    def margins(self, rows: DataFrame) -> DataFrame:
        """Raw value of each base as `_m0`, `_m1`, ... beside the given columns."""
        given, wide = rows.columns, self.scaled(rows) if self.names else rows
        for i, base in enumerate(self.bases):
            wide = margin(base.transform(wide), f"_m{i}")
        return wide.select(*given, *[f"_m{i}" for i in range(len(self.bases))])

    def probability(self, i: int) -> Column:
        slope, shift = self.sigmoids[i]
        return 1 / (1 + F.exp(-(F.lit(slope) * F.col(f"_m{i}") + F.lit(shift))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = sum((self.probability(i) for i in range(len(self.bases))), F.lit(0.0)) / len(self.bases)
        return self.margins(dataset).select(*dataset.columns, score.alias("score"))

    def coefficients(self) -> dict[str, float]:
        """Mean coefficient of each feature over the base models; empty for trees."""
        if not all(hasattr(b, "coefficients") for b in self.bases):
            return {}
        each = [b.coefficients.toArray() for b in self.bases]
        return {n: float(sum(c[i] for c in each) / len(each)) for i, n in enumerate(self.names)}

    def trees(self) -> list[tuple[int, int]]:
        """(number of trees, greatest depth) of each base; empty for linear models."""
        return [(len(b.trees), max(t.depth for t in b.trees)) for b in self.bases if hasattr(b, "trees")]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Metadata with scaler and sigmoids, and one folder for each base model."""

    def __init__(self, model: CalibratedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        held = {"kind": m.kind, "names": m.names, "means": m.means, "deviations": m.deviations, "sigmoids": m.sigmoids, "bases": len(m.bases)}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"calibrated": held})
        for i, base in enumerate(m.bases):
            base.write().save(f"{path}/base-{i}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CalibratedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held = metadata["calibrated"]
        bases = [DefaultParamsReader.loadParamsInstance(f"{path}/base-{i}", self.sparkSession) for i in range(held.pop("bases"))]
        model = self.cls(bases=bases, **held)
        model._resetUid(metadata["uid"])
        return model


def fit_parts(model: CalibratedModel, vectors: DataFrame, rounds: int, parts: int, workers: int) -> CalibratedModel:
    """Fill a model with base models and sigmoids from rows with (symbol, bar_date, label, features)."""
    split = cut(inner_folds(vectors, parts))
    train = checkpointed(split.coalesce(max(1, math.ceil(split.count() / PARTITION_ROWS))))

    def fit(part: int):
        base = fit_base(train.filter(F.col("_part") != part), model.kind, rounds)
        return base, fit_sigmoid(margin(base.transform(train.filter(F.col("_part") == part)), "margin"))

    fitted = side_by_side(vectors.sparkSession, [lambda p=p: fit(p) for p in range(parts)], workers, "fit")
    model.bases, model.sigmoids = [b for b, _ in fitted], [s for _, s in fitted]
    return model


class CalibratedClassifier(Estimator):
    """Estimator of `CalibratedModel` from rows with (symbol, bar_date, label, features...).

    Rows with a missing feature or label are left out.  `parts` is the number of base models.
    """

    def __init__(self, names, kind: str = "logistic", rounds: int = 300, parts: int = CALIBRATION_FOLDS, workers: int = CALIBRATION_FOLDS):
        super().__init__()
        self.names, self.kind, self.rounds, self.parts, self.workers = list(names), kind, rounds, parts, workers

    def _fit(self, dataset: DataFrame) -> CalibratedModel:
        spark = dataset.sparkSession
        clean = dataset.na.drop(subset=[*self.names, "label"])
        moments = fit_scaler(clean, self.names, ()).first()
        model = CalibratedModel(self.kind, self.names, [float(moments[f"mean_{n}"]) for n in self.names], [float(moments[f"std_{n}"]) for n in self.names])
        vectors = model.scaled(clean.select("symbol", "bar_date", "label", *self.names)).drop(*self.names)
        return fit_parts(model, vectors, self.rounds, self.parts, self.workers)
