"""Report tables: summaries as (section, key, value) and the first rows of long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from residua.functions.numbers import format_significant
from residua.plans.bundle import ModelBundle
from residua.plans.training import TrainingResult

TOP_ROWS = 25


def key_values(spark: SparkSession, section: str, values: Mapping[str, Any]) -> DataFrame:
    """Known values as text; numbers with five significant digits."""
    rows = [(section, k, f"{v:.5g}" if isinstance(v, (int, float)) else str(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, "section string, key string, value string")


def aggregate_values(section: str, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row aggregate as (section, key, value), without reading it first."""
    numeric = ("int", "bigint", "double", "float")
    pairs = [
        F.struct(
            F.lit(c).alias("key"),
            (format_significant(F.col(f"`{c}`"), 5) if t in numeric else F.col(f"`{c}`").cast("string")).alias("value"),
        )
        for c, t in one_row.dtypes
    ]
    return one_row.select(F.explode(F.array(*pairs)).alias("p")).select(F.lit(section).alias("section"), "p.key", "p.value")


def input_summary(counts: DataFrame, task: str) -> DataFrame:
    """Counters of a validated input table."""
    named = counts.select(
        F.col("valid_unique").alias("Total Valid Peptides"),
        F.col("invalid_rows").alias("Invalid Sequences"),
        F.col("duplicate_rows").alias("Duplicate Sequences"),
    )
    return aggregate_values("input", named).unionByName(key_values(counts.sparkSession, "input", {"Task Type": task}))


def descriptor_summary(descriptors: DataFrame, feature_count: int) -> DataFrame:
    counted = descriptors.agg(F.count("*").alias("Descriptor Rows"))
    computed = counted.select(
        F.when(F.col("Descriptor Rows") > 0, "True").otherwise("False").alias("Descriptors Computed"),
        "Descriptor Rows",
        F.lit(feature_count).alias("Descriptor Feature Count"),
    )
    return aggregate_values("descriptors", computed)


def model_summary(spark: SparkSession, bundle: ModelBundle, metrics: Sequence[str] | None = None, digits: int = 5) -> DataFrame:
    """What the model is, and its metrics on held-out rows with so many decimals."""
    about = {"Model": bundle.model_name, "Target": bundle.target_column, "Task": bundle.task, "Feature Count": str(len(bundle.feature_names))}
    chosen = {k: v for k, v in bundle.metrics.items() if v is not None and (metrics is None or k in metrics)}
    found = {k: f"{v:.{digits}f}" for k, v in chosen.items()}
    return key_values(spark, "model", about).unionByName(key_values(spark, "metrics", found))


def training_summary(result: TrainingResult, target: str) -> DataFrame:
    """Counters of a comparison of models."""
    values = {
        "Model Trained": "True", "Best Model": result.best_model, "Models Compared": len(result.outputs),
        "Training Dataset Size": result.rows, "Target Column": target,
    }
    return key_values(result.comparison.sparkSession, "training", values)


def best_predictions(ranked: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    """The best rows of a ranked table for the report."""
    return ranked.filter(F.col("Rank") <= rows).orderBy("Rank")


def leaderboard_section(comparison: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The comparison of models as (section, key, value), one row per model and metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("number")) for m in metrics])).alias("p")
    long = comparison.select("Model", pairs).where("p.number is not null")
    return long.select(F.lit("leaderboard").alias("section"), F.concat("Model", F.lit(" "), "p.metric").alias("key"), format_significant(F.col("p.number"), 5).alias("value"))
