"""Fitted feature preprocessing: impute, drop flat and correlated columns, scale, project.

Fitting reads the table in a few aggregations and leaves a small state of numbers; applying the
state is one projection.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from residua.functions.sequences import to_number
from residua.operators.columns import long_values
from residua.operators.profiling import correlation_values
from residua.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class PreprocessingConfig:
    impute_strategy: str = "median"  # median, mean, most_frequent
    scaler: str = "standard"  # standard, minmax, robust, none
    variance_threshold: float = 0.0
    correlation_threshold: float = 0.95
    use_pca: bool = False
    pca_components: int = 20


def stabilized(config: PreprocessingConfig, task: str, descriptors: int, rows: int) -> PreprocessingConfig:
    """Compact PCA space and a tighter correlation limit for regression on few rows."""
    if task != "regression" or rows <= 0 or descriptors <= max(30, 2 * rows):
        return config
    return PreprocessingConfig(
        config.impute_strategy,
        config.scaler,
        config.variance_threshold,
        min(config.correlation_threshold, 0.90),
        True,
        max(2, min(25, descriptors, max(2, rows // 4))),
    )


def impute_values(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> dict[str, float | None]:
    """Fill value per column; null for a column without any value."""
    if strategy == "median":
        found = exact_quantiles(df, columns, [0.5])
        return {c: found[c].values[0.5] for c in columns}
    if strategy == "mean":
        stats = column_stats(df, columns)
        return {c: stats[c].mean if c in stats else None for c in columns}
    if strategy != "most_frequent":
        raise ValueError(f"Unknown impute strategy: {strategy}")
    counted = long_values(df, columns).groupBy("place", "v").agg(F.count("*").alias("n"))
    best = counted.groupBy("place").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    modes = {r["place"]: r["b"]["v"] for r in best.collect()}
    return {c: modes.get(i) for i, c in enumerate(columns)}


def fill_missing(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Columns as numbers with gaps filled; a column without a fill value is left out."""
    types = dict(df.dtypes)
    kept = [c for c in df.columns if c not in values or values[c] is not None]
    return df.select(
        *[
            F.coalesce(to_number(F.col(f"`{c}`"), types[c]), F.lit(float(values[c]))).alias(c)
            if c in values
            else F.col(f"`{c}`")
            for c in kept
        ]
    )


@dataclass(frozen=True)
class ColumnStats:
    mean: float
    variance: float
    minimum: float
    maximum: float


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """Mean, population variance and range of every column, in one pass."""
    stats = long_values(df, columns).groupBy("place").agg(
        F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    found = {columns[r["place"]]: ColumnStats(r["mean"], r["variance"], r["low"], r["high"]) for r in stats.collect()}
    return {c: found[c] for c in columns if c in found}


def varying_columns(stats: dict[str, ColumnStats], threshold: float = 0.0) -> list[str]:
    """Columns with a population variance above the threshold and more than one value."""
    return [c for c, s in stats.items() if s.variance > max(threshold, 0.0) and s.minimum < s.maximum]


def uncorrelated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns not too correlated with any earlier column, kept or not; all of them from 1 upwards."""
    if len(columns) <= 1 or threshold >= 1.0:
        return list(columns)
    values = correlation_values(df, columns)
    dropped = {later for (_, later), r in values.items() if r is not None and abs(r) > threshold}
    return [c for c in columns if c not in dropped]


def scaling(df: DataFrame, stats: dict[str, ColumnStats], columns: Sequence[str], scaler: str) -> dict[str, tuple[float, float]]:
    """(centre, scale) per column; a scale of zero counts as one."""
    scaler = (scaler or "none").lower()
    if scaler == "standard":
        pairs = {c: (stats[c].mean, stats[c].variance**0.5) for c in columns}
    elif scaler == "minmax":
        pairs = {c: (stats[c].minimum, stats[c].maximum - stats[c].minimum) for c in columns}
    elif scaler == "robust":
        found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        pairs = {c: (found[c].values[0.5], found[c].values[0.75] - found[c].values[0.25]) for c in columns}
    else:
        pairs = {c: (0.0, 1.0) for c in columns}
    return {c: (float(centre), float(scale) or 1.0) for c, (centre, scale) in pairs.items()}


def scale_columns(df: DataFrame, pairs: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in pairs.items()})


@dataclass
class FittedPreprocessor:
    """State of a fitted preprocessor; `pca` is set when the features are projected."""

    input_columns: list[str]
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    offset: list[float] = field(default_factory=list)
    pca: PCAModel | None = None

    @property
    def kept(self) -> list[str]:
        return list(self.scale)

    @property
    def output_names(self) -> list[str]:
        return self.kept if self.pca is None else [f"PC{i + 1}" for i in range(self.pca.getK())]

    def _values(self, df: DataFrame) -> list[Column]:
        types = dict(df.dtypes)
        values = []
        for i, (c, (centre, scale)) in enumerate(self.scale.items()):
            fill = F.lit(float(self.fill[c]))
            value = F.coalesce(to_number(F.col(f"`{c}`"), types[c]), fill) if c in types else fill
            scaled = (value - F.lit(centre)) / F.lit(scale)
            values.append(scaled - F.lit(self.offset[i]) if self.offset else scaled)
        return values

    def transform(self, df: DataFrame, keep: Sequence[str], output: str = "features") -> DataFrame:
        """Kept columns and the feature vector."""
        vector = array_to_vector(F.array(*self._values(df)))
        rows = df.select(*[F.col(f"`{c}`") for c in keep], vector.alias(output))
        if self.pca is None:
            return rows
        projected = self.pca.setInputCol(output).setOutputCol("__projected").transform(rows)
        return projected.drop(output).withColumnRenamed("__projected", output)

    def state(self) -> str:
        plain = {k: v for k, v in asdict(self).items() if k != "pca"} if self.pca is None else {
            "input_columns": self.input_columns, "fill": self.fill, "scale": self.scale, "offset": self.offset,
        }
        return json.dumps(plain)

    @staticmethod
    def from_state(text: str, pca: PCAModel | None = None) -> FittedPreprocessor:
        plain = json.loads(text)
        return FittedPreprocessor(
            plain["input_columns"], plain["fill"], {c: tuple(p) for c, p in plain["scale"].items()}, plain["offset"], pca
        )


def fit_preprocessor(df: DataFrame, columns: Sequence[str], config: PreprocessingConfig = PreprocessingConfig()) -> FittedPreprocessor:
    if not columns:
        raise ValueError("No numeric descriptor columns available.")
    fill = {c: float(v) for c, v in impute_values(df, columns, config.impute_strategy).items() if v is not None}
    complete = fill_missing(df.select(*[F.col(f"`{c}`") for c in fill]), fill)
    stats = column_stats(complete, list(fill))
    varying = varying_columns(stats, config.variance_threshold)
    kept = uncorrelated_columns(complete, varying, config.correlation_threshold)
    if not kept:
        raise ValueError("No descriptor column varies.")
    fitted = FittedPreprocessor(list(columns), fill, scaling(complete, stats, kept, config.scaler))
    if config.use_pca:
        fitted.offset = [(stats[c].mean - m) / s for c, (m, s) in fitted.scale.items()]
        k = min(max(2, min(config.pca_components, len(kept))), len(kept))
        rows = fitted.transform(complete, [])
        fitted.pca = PCA(k=k, inputCol="features", outputCol="projected").fit(rows)
    return fitted
