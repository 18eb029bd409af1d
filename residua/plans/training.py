"""Train and compare: split, preprocess, fit, cross-validate, rank and refit models."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from residua.functions.descriptors import DescriptorConfig, descriptor_columns
from residua.functions.naming import BINARY, REGRESSION, model_family, task_type
from residua.functions.sequences import to_number
from residua.operators import metrics as M
from residua.operators import selection as SEL
from residua.operators.preprocessing import FittedPreprocessor, PreprocessingConfig, fit_preprocessor
from residua.operators.splitting import REPEATS, SplitConfig, cv_folds, fold_count, with_split
from residua.operators.storage import materialize, spread, temporary
from residua.plans import class_folds
from residua.plans.bundle import ModelBundle
from residua.plans.linear_folds import PENALTIES, linear_fold_metrics
from residua.plans.models import NEIGHBORS, catalogue, fit_model

#: Labels kept on the driver; a target with more is a list of names rather than of classes.
MOST_CLASSES, BROADCAST_CLASSES = 1_000_000, 100_000


@dataclass
class ModelOutput:
    """One model: its bundle (refitted on all rows) and what the train-only fit predicted."""

    bundle: ModelBundle | None
    test: DataFrame
    validation: DataFrame
    folds: DataFrame | None


@dataclass
class TrainingResult:
    task: str
    comparison: DataFrame
    outputs: dict[str, ModelOutput]
    best_model: str
    rows: int


def prepare_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str] | None]:
    """Rows with a usable target as `y`: a number, or the place of the class in sorted order."""
    value = F.col(f"`{target}`")
    if task == REGRESSION:
        number = to_number(value, dict(df.dtypes)[target])
        return df.withColumn("y", number).filter(F.col("y").isNotNull()), None
    text = F.trim(value.cast("string"))
    present = df.withColumn("__class", text).filter(F.col("__class").isNotNull() & ~F.col("__class").isin("", "nan", "None"))
    labels = sorted(r[0] for r in present.select("__class").distinct().limit(MOST_CLASSES + 1).collect())
    if len(labels) > MOST_CLASSES:
        raise ValueError(f"The target '{target}' has more than {MOST_CLASSES} different values.")
    places = df.sparkSession.createDataFrame([(label, float(i)) for i, label in enumerate(labels)], "__label string, y double")
    small = F.broadcast(places) if len(labels) <= BROADCAST_CLASSES else places
    return present.drop("y").join(small, F.col("__class") == F.col("__label")).drop("__class", "__label"), labels


@dataclass(frozen=True)
class _Data:
    """Training rows as (`id`, `y`, `features`, fold columns) with what all models need to know."""

    task: str
    labels: list[str] | None
    train: DataFrame
    rows: int
    width: int
    names: list[str]
    selected: list[int] | None

    @property
    def classes(self) -> int:
        return len(self.labels) if self.labels else 1


def _select(task: str, rows: DataFrame, names: list[str], percentile: int) -> list[int] | None:
    if percentile >= 100:
        return None
    columns = rows.select("y", vector_to_array("features").alias("v")).select(
        "y", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(len(names))]
    )
    score = SEL.f_regression if task == REGRESSION else SEL.f_classif
    scores = score(columns, [f"f{i}" for i in range(len(names))], "y")
    return [int(c[1:]) for c in SEL.select_percentile(scores, percentile)]


def _dealt_join(wide: DataFrame, narrow: DataFrame, key: str) -> DataFrame:
    """Join on a key that both sides are dealt to all cores by, so that wide rows are moved once."""
    parts = 3 * max(wide.sparkSession.sparkContext.defaultParallelism, 1)
    return wide.repartition(parts, key).join(narrow.repartition(parts, key).hint("merge"), key)


def _placed(table: DataFrame, task: str, split: SplitConfig) -> DataFrame:
    """Rows of the training table with their split: only ids and targets are put in order."""
    dealt = with_split(table.select("__row", "id", "y"), "id", "y", task, split).select("__row", "split")
    return _dealt_join(table, dealt, "__row").drop("__row")


def _target_scale(task: str, rows: DataFrame) -> tuple[float, float, int]:
    """Mean, population deviation and count; classes are left as they are."""
    row = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.count("*").alias("n")).first()
    return (row["m"], row["s"] or 1.0, row["n"]) if task == REGRESSION else (0.0, 1.0, row["n"])


def _labelled(rows: DataFrame, mean: float, scale: float) -> DataFrame:
    return rows.withColumn("label", (F.col("y") - F.lit(mean)) / F.lit(scale))


def _fit(name: str, data: _Data, rows: DataFrame, options: Mapping[str, Any] | None):
    mean, scale, count = _target_scale(data.task, rows)
    model = fit_model(name, data.task, _labelled(rows, mean, scale), count, data.width, data.classes, data.selected, options)
    return model, mean, scale


def _predictions(model, rows: DataFrame, mean: float, scale: float, task: str) -> DataFrame:
    scored = model.predict(rows.select("id", "y", "features"), "id").drop("features")
    back = F.col("prediction") * F.lit(scale) + F.lit(mean) if task == REGRESSION else F.col("prediction")
    return scored.withColumn("prediction", back)


def _holdout_metrics(task: str, labels: list[str] | None, predicted: DataFrame) -> dict[str, float]:
    if task == REGRESSION:
        return M.regression_metrics(predicted, "y", "prediction").first().asDict()
    found = M.classification_metrics(predicted, "y", "prediction").first().asDict()
    found["ROC_AUC"] = None
    if "probability" in predicted.columns and predicted.select("y").distinct().limit(3).count() == 2:
        scored = predicted.select("y", F.get("probability", F.lit(1)).alias("p"))
        found["ROC_AUC"] = M.roc_auc(scored, "y", "p").first()[0]
    return found


def with_folds(train: DataFrame, folds: int, repeats: int, label: str | None) -> DataFrame:
    """Training rows with one fold column per repeat."""
    with temporary(train.sparkSession):
        dealt = cv_folds(train, "id", folds, label, repeats)
        wide = dealt.groupBy("id").agg(
            *[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"fold_{r}") for r in range(repeats)]
        )
        return materialize(_dealt_join(train, wide, "id"), "folds", keep=1)


def cross_validate(
    name: str, data: _Data, folds: int, repeats: int, options: Mapping[str, Any] | None = None, parallelism: int = 4
) -> DataFrame:
    """Metrics per (repeat, fold). Fits are driven by a bounded number of threads, scoring is one job.

    The neighbours of a fold take all cores and tables of their own, so one fold is searched at a time.
    """

    def run(place: tuple[int, int]) -> DataFrame:
        repeat, fold = place
        inside = F.col(f"fold_{repeat}") == fold
        model, mean, scale = _fit(name, data, data.train.filter(~inside), options)
        scored = _predictions(model, data.train.filter(inside), mean, scale, data.task)
        return scored.select("y", "prediction", F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"))

    places = [(r, f) for r in range(repeats) for f in range(folds)]
    with ThreadPoolExecutor(max_workers=1 if name == NEIGHBORS else parallelism) as pool:
        scored = reduce(DataFrame.unionByName, pool.map(run, places))
    group = ["repeat", "fold"]
    if data.task == REGRESSION:
        return M.regression_metrics(scored, "y", "prediction", group).withColumnsRenamed(_FOLD_NAMES)
    found = M.classification_metrics(scored, "y", "prediction", group)
    return found.select(*group, F.col("Accuracy").alias("accuracy"), F.col("F1").alias("f1_weighted"))


_FOLD_NAMES = {"R2": "r2", "RMSE": "root_mean_squared_error", "MAE": "mean_absolute_error"}
_FOLD_METRICS = {True: ["r2", "root_mean_squared_error", "mean_absolute_error"], False: ["accuracy", "f1_weighted"]}


def train_and_compare(
    df: DataFrame,
    target: str,
    task: str,
    models: Sequence[str],
    id_col: str,
    descriptor_config: DescriptorConfig = DescriptorConfig(),
    preprocessing: PreprocessingConfig = PreprocessingConfig(),
    split: SplitConfig = SplitConfig(),
    folds: int | None = 5,
    options: Mapping[str, Mapping[str, Any]] | None = None,
    parallelism: int = 4,
    refit: bool = True,
    feature_percentile: int = 100,
) -> TrainingResult:
    """Compare models on a descriptor table.

    `options` overrides settings of single models; without `folds` the holdout alone decides.
    `feature_percentile` is the share of features kept by their F score; `selection.selection_percentile`
    gives the usual one for tables with few rows.
    """
    task, options = task_type(task), options or {}
    columns = [c for c in descriptor_columns(df) if c != target]
    chosen = [m for m in models if m in catalogue(task)]
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' was not found.")
    if not columns or not chosen:
        raise ValueError("Descriptor columns and at least one known model are needed.")
    usable, labels = prepare_target(df, target, task)
    numbered = usable.select(F.col(id_col).cast("bigint").alias("id"), "y", *[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("__row"))
    with temporary(df.sparkSession):  # tables that only lead to the prepared rows
        table = materialize(numbered, "training")
        total = table.count()
        if not total:
            raise ValueError("No rows with a usable target remain.")
        if task == BINARY and len(labels) != 2:
            raise ValueError("Binary classification needs exactly two classes.")
        full = _full_data(task, labels, table, columns, preprocessing, total, feature_percentile) if refit else None
        placed = materialize(_placed(table, task, split), "split")
        preprocessor = fit_preprocessor(placed.filter("split = 'train'"), columns, preprocessing)
        prepared = materialize(preprocessor.transform(placed, ["id", "y", "split"]), "prepared", keep=1)  # `placed` is dealt to all cores
    train = prepared.filter("split = 'train'").drop("split")
    rows = train.count()
    smallest = None if labels is None else train.groupBy("y").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    k = fold_count(task, folds, rows, smallest) if folds else None
    repeats = REPEATS if task == REGRESSION else 1
    names = preprocessor.output_names
    if k:
        train = with_folds(train, k, repeats, "y" if labels is not None else None)
    data = _Data(task, labels, train, rows, len(names), names, _select(task, train, names, feature_percentile))

    linear = [m for m in chosen if task == REGRESSION and m in PENALTIES and not options.get(m)]
    linear_folds = None
    if k and linear:
        found = linear_fold_metrics(train, linear, k, repeats, data.selected, data.width)
        linear_folds = materialize(found.withColumnsRenamed(_FOLD_NAMES), "folds")
    train.persist()  # read once per fit; a lost block is read again from the stored table
    records, outputs = [], {}
    for name in chosen:
        model, mean, scale = _fit(name, data, train, options.get(name))
        test = _predictions(model, prepared.filter("split = 'test'"), mean, scale, task)
        validation = _predictions(model, prepared.filter("split = 'val'"), mean, scale, task)
        metrics = _holdout_metrics(task, labels, test)
        cv, fold_metrics = {}, None
        if k:
            if name in linear:
                fold_metrics = linear_folds.filter(F.col("Model") == name).drop("Model")
            elif task != REGRESSION and not options.get(name) and class_folds.takes(name, data.width, data.classes):
                found = class_folds.class_fold_metrics(train, name, k, repeats, data.classes, data.selected, data.width)
                fold_metrics = materialize(found, "folds")
            else:
                fold_metrics = cross_validate(name, data, k, repeats, options.get(name), parallelism)
            cv = M.fold_summary(fold_metrics, _FOLD_METRICS[task == REGRESSION], []).first().asDict()
        primary = cv.get("CV_r2_mean", metrics.get("R2")) if task == REGRESSION else cv.get("CV_f1_weighted_mean", metrics.get("F1"))
        finite = primary is not None and math.isfinite(primary)
        records.append({
            "Model": name, "ModelFamily": model_family(name), **metrics, **cv,
            "SelectedFeatures": len(data.selected) if data.selected is not None else len(names),
            "PrimaryScore": primary, "FitQuality_0_100": max(0.0, min(100.0, 100.0 * primary)) if finite else 0.0,
        })
        bundle = _refit(name, full, options.get(name), descriptor_config, columns, target, metrics, cv) if full else None
        outputs[name] = ModelOutput(bundle, _decoded(test, labels), _decoded(validation, labels), fold_metrics)
    train.unpersist()
    comparison = leaderboard(df, records)
    best = max(records, key=lambda r: -math.inf if r["PrimaryScore"] is None else r["PrimaryScore"])["Model"]
    return TrainingResult(task, comparison, outputs, best, total)


def leaderboard(df: DataFrame, records: list[dict[str, Any]]) -> DataFrame:
    """One row per model, best primary score first."""
    keys = list(dict.fromkeys(k for r in records for k in r))
    kinds = {"Model": "string", "ModelFamily": "string", "SelectedFeatures": "int"}
    schema = ", ".join(f"`{k}` {kinds.get(k, 'double')}" for k in keys)
    rows = [tuple(r.get(k) if k in kinds or r.get(k) is None else float(r[k]) for k in keys) for r in records]
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("PrimaryScore").desc_nulls_last(), "Model")


@dataclass(frozen=True)
class _Full:
    data: _Data
    preprocessor: FittedPreprocessor


def _full_data(
    task: str, labels, table: DataFrame, columns: list[str], config: PreprocessingConfig, total: int, percentile: int
) -> _Full:
    """All rows under a preprocessor of their own, for the models that are kept."""
    preprocessor = fit_preprocessor(table, columns, config)
    rows = materialize(spread(preprocessor.transform(table, ["id", "y"]), "id"), "all", keep=1)
    names = preprocessor.output_names
    return _Full(_Data(task, labels, rows, total, len(names), names, _select(task, rows, names, percentile)), preprocessor)


def _refit(name: str, full: _Full, options, config: DescriptorConfig, columns: list[str], target: str, metrics, cv) -> ModelBundle:
    model, mean, scale = _fit(name, full.data, full.data.train, options)
    return ModelBundle(
        full.data.task, name, model, full.preprocessor, config, columns, target, full.data.labels, mean, scale, dict(metrics), dict(cv)
    )


def _decoded(predicted: DataFrame, labels: list[str] | None) -> DataFrame:
    if labels is None:
        return predicted

    def name(code: Column) -> Column:
        return F.get(F.array(*[F.lit(label) for label in labels]), code.cast("int"))

    return predicted.withColumns({"y": name(F.col("y")), "prediction": name(F.col("prediction"))})
