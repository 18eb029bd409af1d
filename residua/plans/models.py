"""Model catalogue: names of the supported models and how each is fitted on Spark.

All models share one shape: fit on (`id`, `features`, `label`), predict `prediction` and, for
classes, `probability`. Regression labels are standardised before they get here.

Approximations: kernel machines use random Fourier features with a linear model on top, for numbers under an ε-insensitive loss.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from residua.functions.kernel import RandomFourierFeatures
from residua.functions.naming import REGRESSION, task_type
from residua.operators.neighbors import nearest_neighbors, neighbor_classes, neighbor_regression
from residua.plans.boosting import SoftmaxBoosting
from residua.plans.epsilon import EpsilonInsensitiveRegression
from residua.plans.extra_trees import ExtraTrees

SEED = 42
KERNEL_DIMENSIONS = 256
#: The node state of all trees is held on the driver while they grow, so the default depth is bounded; `options` may raise it.
TREE_DEPTH = 12
SELECTED = "selected"


@dataclass(frozen=True)
class FitContext:
    """What a builder needs to know about the training rows."""

    rows: int
    features: int
    classes: int
    feature_variance: float
    column: str
    options: Mapping[str, Any] = field(default_factory=dict)


def feature_variance(df: DataFrame, column: str = "features") -> float:
    """Variance over all entries of the feature matrix."""
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s")).first()["s"]
    mean, variance, rows = row["mean"].toArray(), row["variance"].toArray(), row["count"]
    spread = variance * (rows - 1) / max(rows, 1)
    return float((spread + mean**2).mean() - mean.mean() ** 2) or 1.0


def _linear(ctx: FitContext, reg: float, ratio: float) -> list:
    defaults = {"regParam": reg, "elasticNetParam": ratio, "standardization": False, "maxIter": 1000, "tol": 1e-8}
    return [MR.LinearRegression(featuresCol=ctx.column, **(defaults | dict(ctx.options)))]


def _forest(ctx: FitContext, trees: int, regression: bool) -> list:
    estimator = MR.RandomForestRegressor if regression else MC.RandomForestClassifier
    defaults = {"numTrees": trees, "maxDepth": TREE_DEPTH, "featureSubsetStrategy": "all" if regression else "sqrt", "seed": SEED}
    return [estimator(featuresCol=ctx.column, **(defaults | dict(ctx.options)))]


def _extra_trees(ctx: FitContext, regression: bool) -> list:
    defaults = {"numTrees": 500, "maxDepth": TREE_DEPTH, "seed": SEED, "classes": 0 if regression else ctx.classes}
    return [ExtraTrees(featuresCol=ctx.column, **(defaults | dict(ctx.options)))]


def _boosting(ctx: FitContext, regression: bool) -> list:
    settings = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": SEED} | dict(ctx.options)
    if regression:
        return [MR.GBTRegressor(featuresCol=ctx.column, **settings)]
    if ctx.classes <= 2:
        return [MC.GBTClassifier(featuresCol=ctx.column, **settings)]
    settings.pop("seed")
    return [SoftmaxBoosting(featuresCol=ctx.column, classes=ctx.classes, **settings)]


def _kernel(ctx: FitContext, regression: bool, cost: float) -> list:
    options = {"dimensions": KERNEL_DIMENSIONS, "maxIter": 80} | dict(ctx.options)
    gamma = 1.0 / (ctx.features * ctx.feature_variance)
    mapped = RandomFourierFeatures(
        inputCol=ctx.column, outputCol="kernel", gamma=gamma, inputSize=ctx.features, dimensions=options["dimensions"], seed=SEED
    )
    reg = 1.0 / (cost * ctx.rows)
    if regression:
        return [mapped, EpsilonInsensitiveRegression(featuresCol="kernel", regParam=reg, maxIter=options["maxIter"], tol=1e-5)]
    machine = MC.LinearSVC(featuresCol="kernel", regParam=reg, standardization=False)
    if ctx.classes > 2:
        machine = MC.OneVsRest(classifier=machine, featuresCol="kernel", predictionCol="side")
    else:
        machine.setPredictionCol("side")
    calibrated = MC.LogisticRegression(featuresCol="rawPrediction", rawPredictionCol="calibrated")
    return [mapped, machine, calibrated]


def _logistic(ctx: FitContext) -> list:
    defaults = {"regParam": 1.0 / ctx.rows, "standardization": False, "maxIter": 4000}
    return [MC.LogisticRegression(featuresCol=ctx.column, **(defaults | dict(ctx.options)))]


def _perceptron(ctx: FitContext) -> list:
    settings = {"maxIter": 300, "seed": SEED} | dict(ctx.options)
    return [MC.MultilayerPerceptronClassifier(featuresCol=ctx.column, layers=[ctx.features, 128, 64, ctx.classes], **settings)]


NEIGHBORS = "kNN"
Builder = Callable[[FitContext], list]


def catalogue(task: str) -> dict[str, Builder | None]:
    """Model name -> builder of pipeline stages; the neighbour model has no stages."""
    if task_type(task) == REGRESSION:
        return {
            "Linear Regression": lambda c: _linear(c, 0.0, 0.0),
            "Ridge": lambda c: _linear(c, 1.0 / c.rows, 0.0),
            "Lasso": lambda c: _linear(c, 0.001, 1.0),
            "Elastic Net": lambda c: _linear(c, 0.001, 0.5),
            "Random Forest": lambda c: _forest(c, 400, True),
            "SVR (RBF)": lambda c: _kernel(c, True, 10.0),
            "Gradient Boosting": lambda c: _boosting(c, True),
            "Extra Trees": lambda c: _extra_trees(c, True),
            NEIGHBORS: None,
        }
    return {
        "Logistic Regression": _logistic,
        "Random Forest": lambda c: _forest(c, 500, False),
        "SVM (RBF)": lambda c: _kernel(c, False, 5.0),
        "Gradient Boosting": lambda c: _boosting(c, False),
        "Extra Trees": lambda c: _extra_trees(c, False),
        NEIGHBORS: None,
        "Naive Bayes": lambda c: [MC.NaiveBayes(featuresCol=c.column, modelType="gaussian", **c.options)],
        "MLP Classifier": _perceptron,
    }


class StagesModel:
    """A fitted pipeline."""

    def __init__(self, pipeline: PipelineModel) -> None:
        self.pipeline = pipeline

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        scored = self.pipeline.transform(df)
        keep = [F.col(f"`{c}`") for c in df.columns]
        if "probability" in scored.columns:
            return scored.select(*keep, "prediction", vector_to_array("probability").alias("probability"))
        if "rawPrediction" in scored.columns:
            odds = F.transform(vector_to_array("rawPrediction"), lambda r: F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * r)))
            total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
            return scored.select(*keep, "prediction", F.transform(odds, lambda o: o / total).alias("probability"))
        return scored.select(*keep, "prediction")

    @property
    def core(self):
        return self.pipeline.stages[-1]

    @property
    def selected(self) -> list[int] | None:
        first = self.pipeline.stages[0]
        return list(first.getIndices()) if isinstance(first, VectorSlicer) else None

    @property
    def is_direct(self) -> bool:
        """Whether the model works on the features themselves, not on a kernel map of them."""
        return not any(isinstance(s, RandomFourierFeatures) for s in self.pipeline.stages)

    def weights(self) -> list[float] | None:
        """Coefficients of a linear model with one output."""
        if not self.is_direct or not isinstance(self.core, (MR.LinearRegressionModel, MC.LogisticRegressionModel)):
            return None
        if isinstance(self.core, MC.LogisticRegressionModel) and self.core.numClasses > 2:
            return None
        return [float(w) for w in self.core.coefficients]

    def importance(self) -> list[float] | None:
        """Tree importances, or absolute coefficients averaged over classes."""
        if not self.is_direct:
            return None
        weights = self.weights()
        if weights is not None:
            return [abs(w) for w in weights]
        if isinstance(self.core, MC.LogisticRegressionModel):
            return [float(v) for v in abs(self.core.coefficientMatrix.toArray()).mean(axis=0)]
        found = getattr(self.core, "featureImportances", None)
        return None if found is None else [float(v) for v in found.toArray()]


class NeighborModel:
    """The reference rows themselves; prediction is a neighbour join."""

    def __init__(self, reference: DataFrame, classes: int, k: int = 5) -> None:
        self.reference, self.classes, self.k = reference, classes, k

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        asked = df.select(F.col(id_col).alias("__id"), vector_to_array("features").alias("vector"))
        known = self.reference.select(F.col("id").alias("__id"), vector_to_array("features").alias("vector"), "label")
        found = nearest_neighbors(asked, known, "__id", "__id", "vector", "label", self.k)
        votes = neighbor_regression(found) if self.classes <= 1 else neighbor_classes(found, self.classes)
        return df.join(votes, F.col(id_col) == F.col("query_id")).drop("query_id")

    selected = None

    def weights(self) -> None:
        return None

    def importance(self) -> None:
        return None


def fit_model(
    name: str, task: str, train: DataFrame, rows: int, features: int, classes: int,
    selected: list[int] | None = None, options: Mapping[str, Any] | None = None,
) -> StagesModel | NeighborModel:
    """Fit a catalogue model on (`id`, `features`, `label`)."""
    builder = catalogue(task)[name]
    if builder is None:
        return NeighborModel(train.select("id", "features", "label"), classes, **(options or {}))
    column, stages = "features", []
    if selected is not None:
        column, features = SELECTED, len(selected)
        stages.append(VectorSlicer(inputCol="features", outputCol=SELECTED, indices=selected))
    variance = 1.0
    if "RBF" in name:
        sliced = stages[0].transform(train) if stages else train
        variance = feature_variance(sliced, column)
    stages += builder(FitContext(rows, features, classes, variance, column, options or {}))
    return StagesModel(Pipeline(stages=stages).fit(train))
