"""Rule-window screening of descriptor tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from residua.functions import constants as K
from residua.functions.sequences import to_number
from residua.operators.quantiles import exact_quantiles


def with_screening(df: DataFrame, criteria: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Pass flags per window, their count, the percent score and its assessment.

    Windows of descriptors the table does not have are left out; a missing value does not pass.
    """
    types = dict(df.dtypes)
    windows = {f: w for f, w in (criteria or K.DEFAULT_CRITERIA).items() if f in types}
    if not windows:
        return df.withColumns(
            {
                "StructureQualityScore": F.lit(None).cast("double"),
                "StructureAssessment": F.lit(K.UNCOVERED_ASSESSMENT),
            }
        )
    flags = {}
    for feature, (low, high) in windows.items():
        inside = to_number(F.col(f"`{feature}`"), types[feature]).between(low, high)
        flags[f"Pass_{feature}"] = F.coalesce(inside.cast("int"), F.lit(0))
    flagged = df.withColumns(flags)
    passed = reduce(add, [F.col(c) for c in flags])
    scored = flagged.withColumns(
        {
            "CriteriaPassCount": passed,
            "CriteriaTotal": F.lit(len(flags)),
            "StructureQualityScore": passed / len(flags) * 100.0,
        }
    )
    label = F.lit(K.LOWEST_ASSESSMENT)
    for lowest, name in reversed(K.ASSESSMENTS):
        label = F.when(F.col("StructureQualityScore") >= lowest, name).otherwise(label)
    return scored.withColumn("StructureAssessment", label)


def screening_summary(screened: DataFrame) -> DataFrame:
    """One row: mean and median score, number of rows that score at least 70."""
    score = "StructureQualityScore"
    median = exact_quantiles(screened, [score], [0.5])[score].values[0.5]
    return screened.agg(
        F.avg(score).alias("MeanStructureQualityScore"),
        F.lit(median).cast("double").alias("MedianStructureQualityScore"),
        F.count_if(F.col(score) >= 70).alias("HighQualityCount"),
    )


def score_histogram(screened: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per equal-width score bin and assessment."""
    score = F.col("StructureQualityScore")
    counted = screened.groupBy("StructureQualityScore", "StructureAssessment").agg(F.count("*").alias("n"))
    bounds = counted.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high")).alias("b")).scalar()
    width = (bounds["high"] - bounds["low"]) / bins
    place = F.when(width > 0, F.least(F.floor((score - bounds["low"]) / width), F.lit(bins - 1))).otherwise(0)
    return counted.select(
        place.cast("int").alias("bin"),
        (bounds["low"] + place * width).alias("bin_start"),
        "StructureAssessment",
        "n",
    ).groupBy("bin", "bin_start", "StructureAssessment").agg(F.sum("n").alias("rows"))


def criteria_vector(screened: DataFrame, row_filter) -> DataFrame:
    """Pass flags of the selected row as (Criterion, Passed)."""
    flags = [c for c in screened.columns if c.startswith("Pass_")]
    return (
        screened.filter(row_filter)
        .unpivot([], flags, "Criterion", "Passed")
        .withColumn("Criterion", F.regexp_replace("Criterion", "^Pass_", ""))
    )


def join_screening(predictions: DataFrame, screened: DataFrame, keys: tuple[str, ...] = ("Name", "Sequence")) -> DataFrame:
    """Predictions with the screening columns of the same peptide; missing names match each other."""
    extra = ["StructureQualityScore", "StructureAssessment", "CriteriaPassCount", "CriteriaTotal"]
    extra = [c for c in extra + [c for c in screened.columns if c.startswith("Pass_")] if c in screened.columns]
    return _left_join(predictions, screened, keys, extra)


def rank_screening(predictions: DataFrame, screened: DataFrame, keys: tuple[str, ...] = ("Name", "Sequence")) -> DataFrame:
    """The whole screening table in prediction order: keys, rank, then every screening column."""
    ranked = predictions.select(*keys, "Rank")
    return _left_join(ranked, screened, keys, [c for c in screened.columns if c not in (*keys, "Rank")])


def _left_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in columns if c not in left.columns])
    matches = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, matches, "left").drop(*[f"__{k}" for k in keys])
