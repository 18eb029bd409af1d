"""Linear regression with an ε-insensitive loss, for the kernel map of the support vector regressor.

Residuals within ε cost nothing, others their distance from ε, rounded off over a short stretch so that the loss has
a gradient. The weights' squares are penalised by 1 / (C * rows), the intercept is free. Every
step is one scan: tasks sum loss and gradient, which Spark adds up; a quasi-Newton rule with a short memory
chooses the next weights on the driver, as many numbers as there are features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasRegParam, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from residua.operators.array_sums import sum_arrays

#: Stretch over which the loss bends, as a share of ε (or of 0.1 where ε is 0).
BEND, MEMORY, HALVINGS = 0.05, 10, 30


def loss_and_slope(residuals: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounded ε-insensitive loss of residuals (prediction less label), and its derivative."""
    bend = BEND * (epsilon or 0.1)
    over = np.maximum(np.abs(residuals) - epsilon, 0)
    loss = np.where(over < bend, over * over / (2 * bend), over - bend / 2)
    return loss, np.sign(residuals) * np.minimum(over / bend, 1)


def minimised(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Quasi-Newton descent with a memory of a few steps; every call is a scan, so a step is halved only if it goes up."""
    at, (value, gradient) = start, value_and_gradient(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0) < tolerance:
            break
        direction, factors = gradient.copy(), []
        for s, y in reversed(moves):
            factors.append((s @ direction) / (s @ y))
            direction -= factors[-1] * y
        if moves:
            s, y = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), factor in zip(moves, reversed(factors)):
            direction += s * (factor - (y @ direction) / (s @ y))
        length = 1.0 if moves else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        for _ in range(HALVINGS):
            new = at - length * direction
            found, slope = value_and_gradient(new)
            if found <= value - 1e-4 * length * (gradient @ direction):
                break
            length /= 2
        else:
            break
        step, change = new - at, slope - gradient
        if step @ change > 1e-12 * (change @ change):
            moves = [*moves, (step, change)][-MEMORY:]
        done = abs(value - found) <= tolerance * max(abs(value), abs(found), 1e-12)
        at, value, gradient = new, found, slope
        if done:
            break
    return at


class EpsilonInsensitiveRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRegParam, HasMaxIter, HasTol, DefaultParamsReadable, DefaultParamsWritable):
    epsilon = Param(Params._dummy(), "epsilon", "residuals up to this cost nothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", regParam=0.0, epsilon=0.1, maxIter=200, tol=1e-7):
        super().__init__()
        self._setDefault(regParam=0.0, epsilon=0.1, maxIter=200, tol=1e-7)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> EpsilonInsensitiveModel:
        epsilon, reg = self.getOrDefault(self.epsilon), self.getRegParam()
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("v"), F.col(self.getLabelCol()).cast("double").alias("y"))
        first = rows.first()
        size = len(first["v"]) if first else 0

        def value_and_gradient(weights: np.ndarray) -> tuple[float, np.ndarray]:
            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size + 3)
                for batch in batches:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                    loss, slope = loss_and_slope(x @ weights[:-1] + weights[-1] - batch.column(1).to_numpy(zero_copy_only=False), epsilon)
                    total += np.concatenate([x.T @ slope, [slope.sum(), loss.sum(), len(x)]])
                if total[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["k", "value"])

            found = sum_arrays(rows.mapInArrow(sums, "k long, value array<double>"), ["k"]).first()
            total = np.array(found["value"])
            ridge = np.append(np.full(size, reg), 0.0)
            return total[-2] / total[-1] + 0.5 * (ridge * weights * weights).sum(), total[:-2] / total[-1] + ridge * weights

        weights = np.zeros(size + 1)
        if first:
            weights = minimised(value_and_gradient, weights, self.getMaxIter(), self.getTol())
        model = EpsilonInsensitiveModel(
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), weights=weights[:-1].tolist(), intercept=float(weights[-1])
        )
        return self._copyValues(model)


class EpsilonInsensitiveModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "one for each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "prediction where all features are 0", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", weights=(), intercept=0.0):
        super().__init__()
        self._setDefault(intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, intercept = np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.intercept)

        def predict(vectors: pa.Array) -> pa.Array:
            return pa.array(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(weights)) @ weights + intercept)

        udf = F.arrow_udf(predict, DoubleType())
        return dataset.withColumn(self.getPredictionCol(), udf(vector_to_array(F.col(self.getFeaturesCol()))))
