"""Univariate feature scores and percentile selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from residua.operators.columns import correlation


def _long(df: DataFrame, features: Sequence[str], other: str) -> DataFrame:
    """(place, v, t): one row per feature value with the target or class of its row."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.select(F.col(f"`{other}`").alias("t"), F.posexplode(values).alias("place", "v"))
    return rows.filter(F.col("v").isNotNull() & F.col("t").isNotNull())


def f_regression(df: DataFrame, features: Sequence[str], target: str) -> dict[str, float]:
    """F statistic of every feature against a numeric target, from one pass of correlations."""
    place, rows = {c: i for i, c in enumerate(features)}, _long(df, features, target)
    stats = rows.groupBy("place").agg(F.count("*").alias("n"), correlation(F.col("v"), F.col("t")).alias("r")).collect()
    found = {r["place"]: r for r in stats}
    scores = {}
    for c, i in place.items():
        r = found[i]["r"] if i in found else None
        explained = None if r is None or math.isnan(r) else r * r
        scores[c] = 0.0 if explained is None or explained >= 1.0 else explained / (1.0 - explained) * (found[i]["n"] - 2)
    return scores


def f_classif(df: DataFrame, features: Sequence[str], label: str) -> dict[str, float]:
    """One-way analysis of variance of every feature over the classes; one row per class is read."""
    grouped = _long(df, features, label).groupBy("place", "t").agg(
        F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")
    )
    by_place: dict[int, list] = {}
    for r in grouped.collect():
        by_place.setdefault(r["place"], []).append(r)
    scores = {}
    for i, c in enumerate(features):
        classes = by_place.get(i, [])
        rows, k = sum(r["n"] for r in classes), len(classes)
        overall = sum(r["n"] * r["m"] for r in classes) / rows if rows else 0.0
        between = sum(r["n"] * (r["m"] - overall) ** 2 for r in classes)
        within = sum(r["n"] * r["s"] for r in classes)
        scores[c] = (between / (k - 1)) / (within / (rows - k)) if within > 0 and k > 1 and rows > k else 0.0
    return scores


def selection_percentile(features: int, rows: int) -> int:
    """Percent of features to keep: all, unless they greatly outnumber the rows."""
    if features <= max(40, 2 * rows):
        return 100
    wanted = max(10, min(80, 2 * rows))
    return max(10, min(100, round(100 * wanted / features)))


def select_percentile(scores: dict[str, float], percentile: int) -> list[str]:
    """The best-scored share of the features, in column order; equals go to earlier columns."""
    if percentile >= 100:
        return list(scores)
    place = {c: i for i, c in enumerate(scores)}
    best = sorted(scores, key=lambda c: (-scores[c], place[c]))[: max(1, len(scores) * percentile // 100)]
    return sorted(best, key=place.get)


def score_table(spark, scores: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(scores.items()), "Feature string, FScore double")
