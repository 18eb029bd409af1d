"""Gradient boosting of several classes on shared scores: every round adds one shallow tree per class.

A round's residuals are those of the softmax of the scores so far, so the classes' trees of a round are grown side by side: one scan
per level sums, for every tree, node, feature and bin, the rows, residuals and curvatures; a tree's sums are added up in one task, which
hands over the splits. The last level's sums give the leaves by one Newton step, so a round takes as many scans as trees
have levels. Split points are quantiles of each feature, found once, so rows of one class that lie in the same bins end in the same leaves of
every tree: they are counted once and go on as one row with their number. The scores of the rows are stored every few rounds, and
the log loss before each round comes with its first scan. Probabilities are the softmax of the scores, so they sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from residua.operators.array_sums import sum_arrays
from residua.operators.quantiles import exact_quantiles
from residua.operators.storage import materialize
from residua.plans.extra_trees import Tree

BINS, STORED_EVERY, LEAST_ROWS = 32, 10, 1.0
_STATISTICS = 3  # rows, residuals, curvatures


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    return np.array([v[0] for v in tree.value])[tree.place(x)]


def added_scores(x: np.ndarray, rounds: list[list[Tree]], step: float) -> np.ndarray | float:
    total: np.ndarray | float = 0.0
    for trees in rounds:
        total = total + step * np.column_stack([tree_values(tree, x) for tree in trees])
    return total


def histogram(binned: np.ndarray, node: np.ndarray, nodes: int, stats: np.ndarray, bins: int) -> np.ndarray:
    """(nodes, features, bins, statistics) sums of the rows that are in a node."""
    inside = np.flatnonzero(node >= 0)
    width = binned.shape[1]
    slot = ((node[inside, None] * width + np.arange(width)) * bins + binned[inside]).ravel()
    sums = [np.bincount(slot, np.repeat(stats[inside, s], width), nodes * width * bins) for s in range(stats.shape[1])]
    return np.stack(sums, axis=1).reshape(nodes, width, bins, -1)


def best_splits(sums: np.ndarray) -> np.ndarray:
    """(nodes, 3 + 2 * statistics): feature or -1, bin, gain, and the sums of the left and the right side."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    whole = sums.sum(axis=2, keepdims=True)
    right = whole - left
    n, m = left[..., 0], right[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((n >= LEAST_ROWS) & (m >= LEAST_ROWS), (left[..., 1] / n - right[..., 1] / m) ** 2 * n * m / (n + m), -np.inf)
    flat = gain.reshape(len(sums), -1)
    top = flat.max(axis=1, initial=-np.inf)
    best = (flat >= top[:, None] - 1e-9 * np.abs(top[:, None])).argmax(axis=1)  # of equal splits the first, however sums were rounded
    feature, place = np.divmod(best, left.shape[2])
    every, good = np.arange(len(sums)), top > 1e-15
    return np.column_stack([np.where(good, feature, -1), place, np.where(good, top, 0), left[every, feature, place], whole[:, 0, 0] - left[every, feature, place]])


def leaf(stats: np.ndarray, classes: int) -> float:
    """One Newton step for a leaf's rows."""
    return float((classes - 1) / classes * stats[1] / stats[2]) if stats[2] > 1e-150 else 0.0


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below a root", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxIter=100, stepSize=0.1, maxDepth=3, classes=2):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=3, classes=2)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        classes, step, depth = self.getOrDefault(self.classes), self.getStepSize(), self.getOrDefault(self.maxDepth)
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("v"), F.col(self.getLabelCol()).cast("int").alias("y"))
        rows = materialize(rows, "boosting")
        counted = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        counts = np.array([counted.get(c, 0) for c in range(classes)], np.float64)
        prior = np.log(np.maximum(counts, 1e-3) / max(counts.sum(), 1))
        first = rows.first()
        if first is None:
            return self._copyValues(SoftmaxBoostingModel([], prior, step, 0, []))
        width = len(first["v"])
        columns = [f"f{i}" for i in range(width)]
        found = exact_quantiles(rows.select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)]), columns, [i / BINS for i in range(1, BINS)])
        edges = [np.unique(list(found[c].values.values())) for c in columns]
        scored = materialize(_counted(rows, edges, width).withColumn("f", F.array(*[F.lit(float(p)) for p in prior])), "scores")
        rounds: list[list[Tree]] = []
        losses: list[float] = []
        since = 0  # rounds that the stored scores hold
        for n in range(self.getMaxIter()):
            trees, loss = _round(scored, rounds[since:], step, edges, classes, depth, width)
            losses.append(loss)
            if all(len(tree.feature) == 1 for tree in trees):
                break
            rounds.append(trees)
            if len(rounds) - since == STORED_EVERY:
                scored, since = materialize(_advanced(scored, rounds[since:], step, width), "scores"), len(rounds)
        return self._copyValues(SoftmaxBoostingModel(rounds, prior, step, width, losses))


def _counted(rows: DataFrame, edges: list[np.ndarray], width: int) -> DataFrame:
    """Distinct (bins, class) with `w`, their number of rows; a bin is given by its upper edge, the last one by infinity."""
    ends = [np.append(e, np.inf) for e in edges]

    def upper(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
        found = np.column_stack([end[np.searchsorted(e, x[:, j], side="left")] for j, (e, end) in enumerate(zip(edges, ends))])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(found.ravel()))

    binned = rows.select(F.arrow_udf(upper, ArrayType(DoubleType()))("v").alias("v"), "y")
    return binned.groupBy("v", "y").agg(F.count("*").cast("double").alias("w"))


def _advanced(scored: DataFrame, rounds: list[list[Tree]], step: float, width: int) -> DataFrame:
    """Rows with the scores that the rounds add."""

    def add(vectors: pa.Array, scores: pa.Array) -> pa.Array:
        n = len(vectors)
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        found = scores.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) + added_scores(x, rounds, step)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

    return scored.select("v", "y", "w", F.arrow_udf(add, ArrayType(DoubleType()))("v", "f").alias("f"))


def _round(scored: DataFrame, rounds: list[list[Tree]], step: float, edges: list[np.ndarray], classes: int, depth: int, width: int) -> tuple[list[Tree], float]:
    """The trees of a round, a scan per level, and the log loss before it."""
    trees = [Tree([-1], [0.0], [-1], [-1], [np.zeros(1)], [0.0]) for _ in range(classes)]
    open_: list[list[int]] = [[0] for _ in range(classes)]
    loss = 0.0
    bins = max(len(e) for e in edges) + 1
    for level in range(depth):
        live = [c for c in range(classes) if open_[c]]
        if not live:
            break

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros((len(open_[c]), width, bins, _STATISTICS)) for c in live]
            seen = np.zeros(2)
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                weight = batch.column(2).to_numpy(zero_copy_only=False)
                p = softmax(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, classes) + added_scores(x, rounds, step))
                seen += weight.sum(), -(weight * np.log(np.maximum(p[np.arange(n), y], 1e-300))).sum()
                binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
                for total, c in zip(totals, live):
                    residual = (y == c) - p[:, c]
                    stats = np.column_stack([np.ones(n), residual, np.abs(residual) * (1 - np.abs(residual))]) * weight[:, None]
                    slot = np.full(len(trees[c].feature), -1)
                    slot[open_[c]] = np.arange(len(open_[c]))
                    total += histogram(binned, slot[trees[c].place(x)], len(open_[c]), stats, bins)
            if seen[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*live, classes], pa.int64()), pa.array([*(t.ravel() for t in totals), seen], pa.list_(pa.float64()))], ["tree", "value"]
                )

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    v.values.to_numpy() if tree == classes else best_splits(v.values.to_numpy().reshape(-1, width, bins, _STATISTICS)).ravel()
                    for tree, v in zip(batch.column(0).to_pylist(), batch.column(1))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["tree", "value"])

        added = sum_arrays(scored.mapInArrow(sums, "tree long, value array<double>"), ["tree"])
        for row in added.mapInArrow(choose, "tree long, value array<double>").collect():
            value = np.array(row["value"])
            if row["tree"] == classes:
                loss = float(value[1] / value[0]) if level == 0 else loss
            else:
                open_[row["tree"]] = _split(trees[row["tree"]], open_[row["tree"]], value.reshape(-1, 3 + 2 * _STATISTICS), edges, classes)
    return trees, loss


def _split(tree: Tree, nodes: list[int], chosen: np.ndarray, edges: list[np.ndarray], classes: int) -> list[int]:
    still = []
    for node, row in zip(nodes, chosen):
        feature, place = int(row[0]), int(row[1])
        if feature < 0 or place >= len(edges[feature]):
            continue
        tree.feature[node], tree.threshold[node], tree.gain[node] = feature, float(edges[feature][place]), float(row[2])
        for children, stats in ((tree.left, row[3:3 + _STATISTICS]), (tree.right, row[3 + _STATISTICS:])):
            child = len(tree.feature)
            children[node] = child
            for part, value in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.gain), (-1, 0.0, -1, -1, np.array([leaf(stats, classes)]), 0.0)):
                part.append(value)
            still.append(child)
    return still


class SoftmaxBoostingModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLWritable, MLReadable):
    """`losses` holds the log loss of the training rows before each round."""

    def __init__(self, rounds: list[list[Tree]] | None = None, prior: np.ndarray | None = None, step: float = 0.1, width: int = 0, losses: list[float] | None = None) -> None:
        super().__init__()
        self.rounds, self.prior, self.step, self.width, self.losses = rounds or [], prior, step, width, losses or []

    @property
    def featureImportances(self) -> DenseVector:
        total = np.zeros(self.width)
        for tree in (t for trees in self.rounds for t in trees):
            feature, gain = np.array(tree.feature), np.array(tree.gain)
            mine = np.bincount(feature[feature >= 0], gain[feature >= 0], self.width)
            total += mine / (mine.sum() or 1)
        return DenseVector(total / (total.sum() or 1))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast((self.rounds, self.prior))  # maxIter times classes small trees
        width, step = self.width, self.step

        def predict(vectors: pa.Array) -> pa.Array:
            rounds, prior = sent.value
            n = len(vectors)
            scores = np.tile(prior, (n, 1))
            if rounds:
                scores = scores + added_scores(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, width), rounds, step)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(prior), pa.int32()), pa.array(softmax(scores).ravel()))

        scored = dataset.withColumn("__shares", F.arrow_udf(predict, ArrayType(DoubleType()))(vector_to_array(F.col(self.getFeaturesCol()))))
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return scored.withColumns({self.getPredictionCol(): best.cast("double"), self.getProbabilityCol(): array_to_vector("__shares")}).drop("__shares")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: SoftmaxBoostingModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, model = SparkSession.active(), self.instance
        extra = {"prior": model.prior.tolist(), "step": model.step, "width": model.width, "losses": model.losses}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata=extra)
        rows = [
            (n, c, t.feature, t.threshold, t.left, t.right, [float(v[0]) for v in t.value], t.gain) for n, trees in enumerate(model.rounds) for c, t in enumerate(trees)
        ]
        schema = "round int, class int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls: type[SoftmaxBoostingModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SoftmaxBoostingModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rounds: list[list[Tree]] = []
        for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["round"], r["class"])):
            if r["class"] == 0:
                rounds.append([])
            rounds[-1].append(Tree(r["feature"], r["threshold"], r["left"], r["right"], [np.array([v]) for v in r["value"]], r["gain"]))
        model = self.cls(rounds, np.array(metadata["prior"]), metadata["step"], metadata["width"], metadata["losses"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
