"""Column profiles of descriptor tables: variance, distribution, correlation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from residua.operators.columns import long_values
from residua.operators.gram import pairwise_correlations
from residua.operators.quantiles import exact_quantiles


def column_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample variance of every column, in one pass."""
    stats = long_values(df, columns).groupBy("place").agg(F.var_samp("v").alias("Variance"), F.avg("v").alias("Mean"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "__place int, Descriptor string")
    return names.join(stats, F.col("__place") == F.col("place"), "left").select("Descriptor", "__place", "Variance", "Mean")


def top_variance(df: DataFrame, columns: Sequence[str], max_features: int = 12) -> DataFrame:
    """The columns that vary most; equals keep column order."""
    ranked = column_variances(df, columns).orderBy(F.col("Variance").desc_nulls_last(), "__place")
    return ranked.limit(max_features).select("Descriptor", "Variance")


def distribution_summary(df: DataFrame, columns: Sequence[str], max_features: int = 12) -> DataFrame:
    """Range, quartiles and mean of the columns that vary most."""
    ranked = column_variances(df, columns).orderBy(F.col("Variance").desc_nulls_last(), "__place").limit(max_features)
    means = {r["Descriptor"]: r["Mean"] for r in ranked.collect()}
    quartiles = exact_quantiles(df, list(means), [0.25, 0.5, 0.75])
    schema = "Descriptor string, Rows bigint, Min double, Q1 double, Median double, Q3 double, Max double, Mean double"
    rows = []
    for c, mean in means.items():
        q = quartiles[c]
        bounds = [None if v is None else float(v) for v in (q.minimum, *q.values.values(), q.maximum)]
        rows.append((c, q.count, *bounds, mean))
    return df.sparkSession.createDataFrame(rows, schema)


def correlation_values(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every unordered pair over the rows where both are present, null where one does not vary; one scan."""
    values: dict[tuple[str, str], float | None] = dict.fromkeys(itertools.combinations(columns, 2))
    for row in pairwise_correlations(df, columns).collect():  # as many numbers as pairs of columns
        i = row["place"]
        values |= {(columns[i], columns[j]): row["corr"][j] for j in range(i + 1, len(columns))}
    return values


def correlation_matrix(df: DataFrame, columns: Sequence[str], max_features: int | None = None) -> DataFrame:
    """Long form of the correlation matrix of the first columns, both triangles and the diagonal; one scan."""
    used = list(columns)[:max_features]
    names = df.sparkSession.createDataFrame(list(enumerate(used)), "place int, feature_i string")
    cells = names.join(pairwise_correlations(df, used), "place", "left")
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(used) - 1))))
    return cells.select("feature_i", F.get(F.array(*map(F.lit, used)), "j").alias("feature_j"), F.get("corr", "j").alias("corr"))
