"""Cross-validation of naive Bayes and logistic regression, all folds and repeats at once.

Gaussian naive Bayes needs per class the number of rows and the sums of x and x². One scan sums them per (repeat, fold, class); a
fold's model comes from the total less that fold. Logistic regression takes Newton steps: one scan sums the loss,
gradient and curvature of every fold's model over the rows outside its fold, so a step of all folds is one scan, and
the number of scans is that of steps. A last scan scores every row with the models that have not seen it.

The objective is that of the single fits: mean log loss plus a squared penalty of the weights, not of the
intercepts; with two classes one weight per feature, with more one per feature and class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from residua.operators import metrics as M
from residua.operators.array_sums import sum_arrays

NAMES = ("Naive Bayes", "Logistic Regression")
#: Weights of one model up to which its curvature is held whole, (weights)² numbers; beyond that folds are fitted one by one.
MOST_WEIGHTS = 1500
STEPS, TOLERANCE = 50, 1e-9
#: Share of the largest variance that is added to all, as in single fits.
SMOOTHING = 1e-9


def takes(name: str, width: int, classes: int) -> bool:
    """Whether the folds of this model are fitted here."""
    return name == NAMES[0] or name == NAMES[1] and (width + 1) * (1 if classes == 2 else classes) <= MOST_WEIGHTS


def _plain(train: DataFrame, repeats: int) -> DataFrame:
    dealt = F.array(*[F.col(f"fold_{r}").cast("int") for r in range(repeats)])
    return train.select(vector_to_array("features").alias("v"), F.col("y").cast("int").alias("y"), dealt.alias("places"))


def _read(batch: pa.RecordBatch, width: int, used: list[int], repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)[:, used]
    return x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, repeats)


# Naive Bayes


def naive_bayes_models(train: DataFrame, folds: int, repeats: int, classes: int, width: int, used: list[int]) -> np.ndarray:
    """Log share, means and variances of every class, (repeats, folds, classes, 1 + 2 * features), from one scan."""
    size = len(used)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repeats, folds, classes, 1 + 2 * size))
        for batch in batches:
            x, y, places = _read(batch, width, used, repeats)
            parts = np.column_stack([np.ones(len(x)), x, x * x])
            for r in range(repeats):
                for f in range(folds):
                    for c in range(classes):
                        total[r, f, c] += parts[(places[:, r] == f) & (y == c)].sum(axis=0)
        if total[..., 0].any():
            keys = [pa.array(k.ravel(), pa.int64()) for k in np.indices(total.shape[:3])]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(list(total.reshape(-1, 1 + 2 * size)), pa.list_(pa.float64()))], ["r", "f", "c", "value"])

    plain = _plain(train, repeats).mapInArrow(sums, "r long, f long, c long, value array<double>")
    found = np.zeros((repeats, folds, classes, 1 + 2 * size))
    for row in sum_arrays(plain, ["r", "f", "c"]).collect():
        found[row["r"], row["f"], row["c"]] = row["value"]
    outside = found.sum(axis=1, keepdims=True) - found
    n = np.maximum(outside[..., :1], 1)
    mean, square = outside[..., 1:1 + size] / n, outside[..., 1 + size:] / n
    rows = outside[..., :1].sum(axis=2, keepdims=True)
    whole = outside.sum(axis=2, keepdims=True) / np.maximum(rows, 1)
    spread = (whole[..., 1 + size:] - whole[..., 1:1 + size] ** 2).max(axis=-1, keepdims=True)
    variance = square - mean**2 + SMOOTHING * spread
    with np.errstate(divide="ignore"):
        share = np.log(outside[..., :1] / np.maximum(rows, 1))
    return np.concatenate([share, mean, variance], axis=-1)


def naive_bayes_scores(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Unnormalised log probability of every class, (rows, classes)."""
    size = x.shape[1]
    share, mean, variance = model[:, 0], model[:, 1:1 + size], np.maximum(model[:, 1 + size:], 1e-300)
    far = ((x[:, None, :] - mean) ** 2 / variance + np.log(variance)).sum(axis=2)
    return share - 0.5 * far


# logistic regression


def _probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Class shares; `weights` is (outputs, 1 + features), of one output with two classes."""
    z = x @ weights.T
    if weights.shape[0] == 1:
        p = 1 / (1 + np.exp(-np.clip(z[:, 0], -700, 700)))
        return np.column_stack([1 - p, p])
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _step_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and curvature of one model over some rows, as one array."""
    p = _probabilities(x, weights)
    outputs, size = weights.shape
    target = np.eye(p.shape[1])[y]
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    if outputs == 1:
        p, target = p[:, 1:], target[:, 1:]
    gradient = (p - target).T @ x
    curve = np.empty((outputs, size, outputs, size))
    for a in range(outputs):
        for b in range(a, outputs):
            weight = p[:, a] * ((a == b) - p[:, b])
            curve[a, :, b, :] = curve[b, :, a, :] = (x * weight[:, None]).T @ x
    return np.concatenate([[len(y), loss], gradient.ravel(), curve.ravel()])


def logistic_models(train: DataFrame, folds: int, repeats: int, classes: int, width: int, used: list[int], penalty: Callable[[float], float]) -> np.ndarray:
    """Weights (repeats, folds, outputs, 1 + features) of the models that leave one fold out each; a scan per Newton step."""
    outputs, size = (1 if classes == 2 else classes), 1 + len(used)
    weights = np.zeros((repeats, folds, outputs, size))
    plain = _plain(train, repeats)
    open_ = {(r, f) for r in range(repeats) for f in range(folds)}
    before = {place: (np.inf, weights[place].copy()) for place in open_}
    free = np.tile(np.arange(size) == 0, outputs)  # intercepts
    for _ in range(STEPS):
        now, current = sorted(open_), weights.copy()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(now), 2 + outputs * size + (outputs * size) ** 2))
            for batch in batches:
                x, y, places = _read(batch, width, used, repeats)
                x = np.column_stack([np.ones(len(x)), x])
                for k, (r, f) in enumerate(now):
                    seen = places[:, r] != f
                    total[k] += _step_sums(x[seen], y[seen], current[r, f])
            if total[:, 0].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), pa.array(list(total), pa.list_(pa.float64()))], ["k", "value"])

        found = {r["k"]: np.array(r["value"]) for r in sum_arrays(plain.mapInArrow(sums, "k long, value array<double>"), ["k"]).collect()}
        for k, place in enumerate(now):
            if k not in found:
                open_.discard(place)
                continue
            n, loss = found[k][:2]
            w = weights[place].ravel()
            ridge = np.where(free, 0.0, penalty(n))
            value = loss / n + 0.5 * (ridge * w * w).sum()
            best, at = before[place]
            if value > best + 1e-12 * abs(best):  # too far: half the way back
                weights[place] = (weights[place] + at) / 2
                continue
            gradient = found[k][2:2 + len(w)] / n + ridge * w
            curve = found[k][2 + len(w):].reshape(len(w), len(w)) / n + np.diag(ridge)
            before[place] = (value, weights[place].copy())
            if np.abs(gradient).max() < TOLERANCE:
                open_.discard(place)
                continue
            # with several outputs, moving all intercepts alike changes nothing: the least squares step leaves that out
            weights[place] = (w - np.linalg.lstsq(curve, gradient, rcond=1e-14)[0]).reshape(outputs, size)
        if not open_:
            break
    return weights


def class_fold_metrics(
    train: DataFrame, name: str, folds: int, repeats: int, classes: int, selected: list[int] | None, width: int,
    penalty: Callable[[float], float] = lambda rows: 1.0 / rows,
) -> DataFrame:
    """`repeat`, `fold`, `accuracy`, `f1_weighted` of the named model."""
    used = list(range(width)) if selected is None else list(selected)
    if name == NAMES[0]:
        models, scores = naive_bayes_models(train, folds, repeats, classes, width, used), naive_bayes_scores
    else:
        models = logistic_models(train, folds, repeats, classes, width, used, penalty)
        scores = lambda x, model: _probabilities(np.column_stack([np.ones(len(x)), x]), model)

    def score(vectors: pa.Array, places: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)[:, used]
        place = places.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), repeats)
        out = np.empty((len(vectors), repeats))
        for r in range(repeats):
            for f in range(folds):
                at = np.flatnonzero(place[:, r] == f)
                if len(at):
                    out[at, r] = scores(x[at], models[r, f]).argmax(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * repeats, pa.int32()), pa.array(out.ravel()))

    scorer = F.arrow_udf(score, ArrayType(DoubleType()))
    scored = _plain(train, repeats).select(F.col("y").cast("double").alias("y"), "places", scorer("v", "places").alias("p"))
    rows = scored.select("y", "places", F.posexplode("p").alias("repeat", "prediction")).select("y", "prediction", "repeat", F.get("places", "repeat").alias("fold"))
    found = M.classification_metrics(rows, "y", "prediction", ["repeat", "fold"])
    return found.select("repeat", "fold", F.col("Accuracy").alias("accuracy"), F.col("F1").alias("f1_weighted"))
