"""Cross-validation of the linear regressions in two passes over the training rows.

A fit on all folds but one needs only the cross products of those folds. One pass sums the products
per (repeat, fold); each training set is the total less one fold, solved on a matrix as wide as the
features. A second pass scores every row with the models that have not seen it. The number of
passes does not grow with models, folds or repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from residua.operators import metrics as M

# Penalty of each model on a standardised target: (absolute, squared), the squared one per row.
PENALTIES = {
    "Linear Regression": lambda rows: (0.0, 0.0),
    "Ridge": lambda rows: (0.0, 1.0 / rows),
    "Lasso": lambda rows: (0.001, 0.0),
    "Elastic Net": lambda rows: (0.0005, 0.0005),
}
_SWEEPS, _TOLERANCE = 10_000, 1e-7


def _products(rows: DataFrame, repeats: int, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Cross products of (1, features, y) per (repeat, fold). A task sends one matrix per fold."""
    size = width + 2
    folds = [f"fold_{r}" for r in range(repeats)]

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([np.ones(len(batch)), np.stack(batch["v"].to_numpy()), batch["y"].to_numpy()])
            for r, name in enumerate(folds):
                place = batch[name].to_numpy()
                for f in np.unique(place):
                    part = x[place == f]
                    key = (r, int(f))
                    sums[key] = sums.get(key, 0.0) + part.T @ part
        for (r, f), matrix in sums.items():
            yield pd.DataFrame({"repeat": r, "fold": f, "cell": np.arange(size * size), "value": matrix.ravel()})

    plain = rows.select(vector_to_array("features").alias("v"), "y", *folds)
    parts = plain.mapInPandas(accumulate, "repeat int, fold int, cell int, value double")
    summed = parts.groupBy("repeat", "fold", "cell").agg(F.sum("value").alias("value"))
    packed = summed.groupBy("repeat", "fold").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("m"))
    read = packed.select("repeat", "fold", F.col("m.value").alias("m")).collect()
    return {(r["repeat"], r["fold"]): np.array(r["m"]).reshape(size, size) for r in read}


def _solve(products: np.ndarray, penalty: Callable[[np.ndarray], tuple]) -> np.ndarray:
    """(intercept, coefficients) in units of y for a stack of product matrices.

    The penalty applies on the standardised target. The absolute one is met by cyclic coordinate
    steps, taken for all matrices of the stack at once.
    """
    rows = products[:, 0, 0]
    means = products[:, 0, 1:] / rows[:, None]
    spread = products[:, 1:, 1:] / rows[:, None, None] - means[:, :, None] * means[:, None, :]
    scale = np.sqrt(np.maximum(spread[:, -1, -1], 0.0))
    scale[scale == 0.0] = 1.0
    gram, target = spread[:, :-1, :-1], spread[:, :-1, -1] / scale[:, None]
    absolute, squared = penalty(rows)
    width = gram.shape[1]
    if not np.any(absolute):
        system = gram + np.broadcast_to(squared, rows.shape)[:, None, None] * np.eye(width)
        weights = (np.linalg.pinv(system, rcond=1e-12, hermitian=True) @ target[:, :, None])[:, :, 0]
    else:
        weights, pull = np.zeros((len(rows), width)), target.copy()
        curve = np.diagonal(gram, axis1=1, axis2=2)
        for _ in range(_SWEEPS):
            largest = 0.0
            for j in range(width):
                raw = pull[:, j] + curve[:, j] * weights[:, j]
                shrunk = np.sign(raw) * np.maximum(np.abs(raw) - absolute, 0.0)
                new = np.where(curve[:, j] > 0, shrunk / np.maximum(curve[:, j] + squared, 1e-300), 0.0)
                step = new - weights[:, j]
                pull -= gram[:, :, j] * step[:, None]
                weights[:, j] = new
                largest = max(largest, float(np.abs(step).max()))
            if largest < _TOLERANCE:
                break
        else:
            raise ArithmeticError(f"The penalised fit did not converge in {_SWEEPS} sweeps.")
    weights = weights * scale[:, None]
    return np.column_stack([means[:, -1] - (means[:, :-1] * weights).sum(1), weights])


def linear_fold_metrics(train: DataFrame, names: Sequence[str], folds: int, repeats: int, selected: list[int] | None, width: int) -> DataFrame:
    """R2, RMSE and MAE per (Model, repeat, fold) for the named linear models."""
    products = _products(train, repeats, width)
    total = sum(products[(0, f)] for f in range(folds))
    used = list(range(width)) if selected is None else selected
    keep = [0, *[1 + j for j in used], width + 1]
    solved = np.zeros((len(names), repeats, folds, len(used) + 1))
    places = list(products)
    seen = np.stack([(total - products[place])[np.ix_(keep, keep)] for place in places])
    for m, name in enumerate(names):
        for (r, f), weights in zip(places, _solve(seen, PENALTIES[name])):
            solved[m, r, f] = weights

    def score(vectors: pa.Array, places: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)[:, used]
        place = places.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), repeats)
        out = np.empty((len(vectors), len(names), repeats))
        for r in range(repeats):
            for f in range(folds):
                at = np.flatnonzero(place[:, r] == f)
                out[at, :, r] = x[at] @ solved[:, r, f, 1:].T + solved[:, r, f, 0]
        offsets = pa.array(np.arange(len(vectors) + 1) * len(names) * repeats, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    scorer = F.arrow_udf(score, ArrayType(DoubleType()))
    dealt = F.array(*[F.col(f"fold_{r}") for r in range(repeats)])
    scored = train.select("y", dealt.alias("places"), scorer(vector_to_array("features"), dealt).alias("p"))
    long = scored.select("y", "places", F.posexplode("p").alias("at", "prediction"))
    repeat = F.col("at") % repeats
    model = F.get(F.array(*[F.lit(n) for n in names]), F.floor(F.col("at") / repeats).cast("int"))
    rows = long.select(
        model.alias("Model"), repeat.alias("repeat"), F.get("places", repeat).alias("fold"), "y", "prediction"
    )
    return M.regression_metrics(rows, "y", "prediction", ["Model", "repeat", "fold"])
