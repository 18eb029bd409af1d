"""Extremely randomised trees: split points are drawn, not searched, and every tree sees all rows.

Trees grow by level, many at once. For every open node a split point of each feature in play is drawn from the node's box,
that is the root's range cut by the splits above it. One scan sums, per node, feature and side, what a split is judged by
(rows, sum and squares of the label, or rows per class); the best draw splits the node. A node none of whose draws parts its rows
draws again on the next level, a few times. Sums of a tree are added up in one task at a time, which hands over the chosen splits only.

A leaf holds the mean label, or the shares of the classes; a forest's prediction is the mean over its trees. Equal rows with
different labels end in one leaf. Depth is bounded by `maxDepth`; the state of all open nodes of a group of trees is what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from residua.operators.array_sums import sum_arrays

TRIES = 4
#: Numbers that the sums of a group of trees may take in a task: 64 MB.
MOST_SUMS = 8_000_000
PURE = 1e-12


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[np.ndarray]
    gain: list[float]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        moving = np.flatnonzero(feature[at] >= 0)
        while len(moving):
            node = at[moving]
            goes = x[moving, feature[node]] <= threshold[node]
            at[moving] = np.where(goes, left[node], right[node])
            moving = moving[feature[at[moving]] >= 0]
        return at


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Rows times variance, or rows times Gini impurity, of sums in the last axis."""
    if classes:
        n = stats.sum(axis=-1)
        return n - (stats * stats).sum(axis=-1) / np.maximum(n, 1)
    return np.maximum(stats[..., 2] - stats[..., 1] ** 2 / np.maximum(stats[..., 0], 1), 0)


def rows_of(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def leaf_value(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats / max(stats.sum(), 1) if classes else np.array([stats[1] / max(stats[0], 1)])


def _statistics(y: np.ndarray, classes: int) -> np.ndarray:
    return np.eye(classes)[y.astype(int)] if classes else np.column_stack([np.ones(len(y)), y, y * y])


@dataclass
class _Growing:
    tree: Tree
    open: list[int]  # nodes that may be split
    boxes: dict[int, np.ndarray]  # (2, features)
    tries: dict[int, int]
    features: np.ndarray | None = None  # (open, drawn)
    points: np.ndarray | None = None

    def sent(self) -> "_Growing":
        """What a scan needs, as arrays: neither boxes nor leaf values."""
        t = self.tree
        plain = Tree(np.array(t.feature), np.array(t.threshold), np.array(t.left), np.array(t.right), [], [])
        return _Growing(plain, np.array(self.open), {}, {}, self.features, self.points)

    def draw(self, rng: np.random.Generator, drawn: int) -> None:
        boxes = np.stack([self.boxes[node] for node in self.open])
        width = boxes.shape[2]
        if drawn < width:
            self.features = np.argsort(rng.random((len(self.open), width)), axis=1)[:, :drawn]
        else:
            self.features = np.broadcast_to(np.arange(width), (len(self.open), width))
        low, high = (np.take_along_axis(boxes[:, side], self.features, 1) for side in (0, 1))
        self.points = low + rng.random(low.shape) * (high - low)


def side_sums(x: np.ndarray, stats: np.ndarray, slot: np.ndarray, growing: _Growing) -> np.ndarray:
    """(open nodes, drawn + 1, statistics): sums of the rows left of each draw, and of all rows of the node."""
    nodes, drawn = growing.points.shape
    out = np.zeros((nodes, drawn + 1, stats.shape[1]))
    inside = np.flatnonzero(slot >= 0)
    order = inside[np.argsort(slot[inside], kind="stable")]
    if not len(order):
        return out
    mine = slot[order]
    starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    left = x[order[:, None], growing.features[mine]] <= growing.points[mine]
    for s in range(stats.shape[1]):
        value = stats[order, s]
        out[mine[starts], :drawn, s] = np.add.reduceat(left * value[:, None], starts, axis=0)
        out[mine[starts], drawn, s] = np.add.reduceat(value, starts)
    return out


def chosen_splits(sums: np.ndarray, classes: int) -> np.ndarray:
    """(open nodes, 2 + 2 * statistics): the best draw or -1, its gain, and the sums of both sides."""
    left, whole = sums[:, :-1], sums[:, -1:]
    right = whole - left
    parts = (rows_of(left, classes) > 0.5) & (rows_of(right, classes) > 0.5)
    gain = np.where(parts, impurity(whole, classes) - impurity(left, classes) - impurity(right, classes), -np.inf)
    # of draws that part the rows alike the first, however the sums were rounded
    best = (gain >= gain.max(axis=1, keepdims=True) - 1e-9 * np.maximum(impurity(whole, classes), PURE)).argmax(axis=1)
    every = np.arange(len(sums))
    good = parts[every, best]
    return np.concatenate(
        [np.where(good, best, -1)[:, None], np.where(good, gain[every, best], 0)[:, None], left[every, best], right[every, best]], axis=1
    )


def grow(rows: DataFrame, trees: int, classes: int, depth: int, drawn: int, seed: int) -> list[Tree]:
    """Grow trees on rows of (`v` array<double>, `y` double)."""
    statistics = classes or 3
    root, low, high = _root(rows, classes)
    if root is None:
        return []
    width, rng, done = len(low), np.random.default_rng(seed & (2**64 - 1)), []
    drawn = min(drawn, width)
    most = int(min(2 ** min(depth, 40), rows_of(root, classes) // 2 + 1))  # nodes that can be open at once
    group = max(1, min(trees, MOST_SUMS // ((drawn + 1) * statistics * most)))
    for start in range(0, trees, group):
        growing = []
        for _ in range(min(group, trees - start)):
            tree = Tree([-1], [0.0], [-1], [-1], [leaf_value(root, classes)], [0.0])
            growing.append(_Growing(tree, [0] if impurity(root, classes) > PURE else [], {0: np.stack([low, high])}, {0: 0}))
        while any(g.open for g in growing):  # a node is tried TRIES times at most
            _level(rows, growing, rng, drawn, width, classes, depth)
        done += [g.tree for g in growing]
    return done


def _root(rows: DataFrame, classes: int) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Sums of all rows, and the range of each feature."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = 0.0, np.inf, -np.inf
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = total + _statistics(batch.column(1).to_numpy(zero_copy_only=False), classes).sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())) for v in (total, low, high)], ["total", "low", "high"])

    found = rows.mapInArrow(sums, "total array<double>, low array<double>, high array<double>")
    parts = found.select(F.posexplode(F.concat("total", "low", "high")).alias("i", "v"))
    ends = parts.groupBy("i").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("i").collect()
    if not ends:
        return None, np.zeros(0), np.zeros(0)
    first = classes or 3
    width = (len(ends) - first) // 2
    return (
        np.array([r["total"] for r in ends[:first]]), np.array([r["low"] for r in ends[first:first + width]]), np.array([r["high"] for r in ends[first + width:]]),
    )


def _level(rows: DataFrame, growing: list[_Growing], rng: np.random.Generator, drawn: int, width: int, classes: int, depth: int) -> None:
    """Draw, judge and split the open nodes of a group of trees, in one scan."""
    live = [g for g in growing if g.open]
    for g in live:
        g.draw(rng, drawn)
    statistics, asked = classes or 3, [g.sent() for g in live]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(g.open), drawn + 1, statistics)) for g in asked]
        slots = []
        for g in asked:
            slot = np.full(len(g.tree.feature), -1)
            slot[g.open] = np.arange(len(g.open))
            slots.append(slot)
        met = False
        for batch in batches:
            if not batch.num_rows:
                continue
            met = True
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            stats = _statistics(batch.column(1).to_numpy(zero_copy_only=False), classes)
            for total, g, slot in zip(totals, asked, slots):
                total += side_sums(x, stats, slot[g.tree.place(x)], g)
        if met:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(asked))), pa.array([t.ravel() for t in totals], pa.list_(pa.float64()))], ["tree", "value"]
            )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chosen_splits(v.values.to_numpy().reshape(-1, drawn + 1, statistics), classes).ravel() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["tree", "value"])

    added = sum_arrays(rows.mapInArrow(sums, "tree long, value array<double>"), ["tree"])
    for row in added.mapInArrow(choose, "tree long, value array<double>").collect():
        _split(live[row["tree"]], np.array(row["value"]).reshape(-1, 2 + 2 * statistics), classes, statistics, depth)


def _split(g: _Growing, chosen: np.ndarray, classes: int, statistics: int, depth: int) -> None:
    tree, still = g.tree, []
    sides = chosen[:, 2:].reshape(-1, 2, statistics)
    values = sides / np.maximum(sides.sum(axis=2, keepdims=True), 1) if classes else sides[:, :, 1:2] / np.maximum(sides[:, :, :1], 1)
    counts = rows_of(sides, classes)
    parted = ((counts > 1.5) & (impurity(sides, classes) > PURE * np.maximum(1.0, counts))).tolist()
    for k, node in enumerate(g.open):
        best, gain = int(chosen[k, 0]), chosen[k, 1]
        box, tries = g.boxes.pop(node), g.tries.pop(node)
        level, tried = divmod(tries, TRIES)
        if best < 0:
            if tried + 1 < TRIES:
                still.append(node)
                g.boxes[node], g.tries[node] = box, tries + 1
            continue
        feature, point = int(g.features[k, best]), float(g.points[k, best])
        tree.feature[node], tree.threshold[node], tree.gain[node] = feature, point, float(gain)
        for side in (0, 1):
            child = len(tree.feature)
            (tree.left if side == 0 else tree.right)[node] = child
            for part, value in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.gain), (-1, 0.0, -1, -1, values[k, side], 0.0)):
                part.append(value)
            if level + 1 < depth and parted[k][side]:
                inner = box.copy()
                inner[1 - side, feature] = point  # the left side ends at the point, the right one starts there
                still.append(child)
                g.boxes[child], g.tries[child] = inner, (level + 1) * TRIES
    g.open = still


class ExtraTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Fits `numTrees` trees; with `classes` of 0 on numbers, else on the classes 0 to `classes` - 1."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", seed=42, numTrees=500, maxDepth=12, classes=0):
        super().__init__()
        self._setDefault(seed=42, numTrees=500, maxDepth=12, classes=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("v"), F.col(self.getLabelCol()).cast("double").alias("y"))
        classes, first = self.getOrDefault(self.classes), rows.first()
        width = len(first["v"]) if first else 0
        drawn = max(1, int(width**0.5)) if classes else width
        trees = grow(rows, self.getOrDefault(self.numTrees), classes, self.getOrDefault(self.maxDepth), drawn, self.getSeed())
        return self._copyValues(ExtraTreesModel(trees, width, classes))


class ExtraTreesModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLWritable, MLReadable):
    def __init__(self, trees: list[Tree] | None = None, width: int = 0, classes: int = 0) -> None:
        super().__init__()
        self.trees, self.width, self.classes = trees or [], width, classes

    @property
    def featureImportances(self) -> DenseVector:
        """Gain by feature, each tree's sum scaled to one, averaged over trees."""
        total = np.zeros(self.width)
        for tree in self.trees:
            feature, gain = np.array(tree.feature), np.array(tree.gain)
            mine = np.bincount(feature[feature >= 0], gain[feature >= 0], self.width)
            total += mine / (mine.sum() or 1)
        return DenseVector(total / (total.sum() or 1))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # numTrees times at most 2^(maxDepth + 1) nodes, as arrays
        arrays = [Tree(*map(np.array, (t.feature, t.threshold, t.left, t.right)), np.array(t.value), []) for t in self.trees]
        sent = dataset.sparkSession.sparkContext.broadcast(arrays)
        width, classes = self.width, self.classes

        def predict(vectors: pa.Array) -> pa.Array:
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
            out = np.zeros((len(x), classes or 1))
            for tree in sent.value:
                out += tree.value[tree.place(x)]
            out /= max(len(sent.value), 1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        scored = dataset.withColumn("__votes", F.arrow_udf(predict, ArrayType(DoubleType()))(vector_to_array(F.col(self.getFeaturesCol()))))
        if not classes:
            return scored.withColumn(self.getPredictionCol(), F.get("__votes", F.lit(0))).drop("__votes")
        best = F.array_position("__votes", F.array_max("__votes")) - 1
        return scored.withColumns({self.getPredictionCol(): best.cast("double"), self.getProbabilityCol(): array_to_vector("__votes")}).drop("__votes")

    def write(self) -> MLWriter:
        return _TreeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreeReader(cls)


class _TreeWriter(MLWriter):
    def __init__(self, instance: ExtraTreesModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, model = SparkSession.active(), self.instance
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"width": model.width, "classes": model.classes})
        rows = [
            (n, t.feature, t.threshold, t.left, t.right, [v.tolist() for v in t.value], t.gain) for n, t in enumerate(model.trees)
        ]
        schema = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<array<double>>, gain array<double>"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/trees")


class _TreeReader(MLReader):
    def __init__(self, cls: type[ExtraTreesModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ExtraTreesModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
        trees = [Tree(r["feature"], r["threshold"], r["left"], r["right"], [np.array(v) for v in r["value"]], r["gain"]) for r in rows]
        model = self.cls(trees, metadata["width"], metadata["classes"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
