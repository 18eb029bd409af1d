"""Principal components: scores, explained variance, loadings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from residua.operators.preprocessing import PreprocessingConfig, fit_preprocessor


@dataclass(frozen=True)
class PcaAnalysis:
    scores: DataFrame
    explained_variance: DataFrame
    loadings: DataFrame


def pca_analysis(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), n_components: int = 10) -> PcaAnalysis:
    """Components of the median-imputed, standardised columns. The sign of a component is free."""
    spark = df.sparkSession
    config = PreprocessingConfig(correlation_threshold=1.0, use_pca=True, pca_components=n_components)
    fitted = fit_preprocessor(df, columns, config)
    names = fitted.output_names
    projected = fitted.transform(df, keep).withColumn("p", vector_to_array("features"))
    scores = projected.select(*keep, *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    running, explained = 0.0, []
    for name, ratio in zip(names, fitted.pca.explainedVariance.toArray()):
        running += float(ratio)
        explained.append((name, float(ratio), running))
    matrix = fitted.pca.pc.toArray()
    weights = {c: [float(v) for v in matrix[i]] for i, c in enumerate(fitted.kept)}
    weights = {c: weights.get(c, [0.0] * len(names)) for c in columns}  # a flat column carries no weight
    return PcaAnalysis(
        scores,
        spark.createDataFrame(explained, "Component string, ExplainedVarianceRatio double, CumulativeVarianceRatio double"),
        spark.createDataFrame(
            [(c, *w) for c, w in weights.items()], "Feature string, " + ", ".join(f"{n} double" for n in names)
        ),
    )


def embedding(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Two-component PCA coordinates of every row."""
    scores = pca_analysis(df, columns, keep, 2).scores
    return scores.withColumnsRenamed({"PC1": "PCA_1", "PC2": "PCA_2"})


def top_loadings(loadings: DataFrame, component: str = "PC1", top_n: int = 20) -> DataFrame:
    """The strongest features of a component, by absolute weight, shown by signed weight."""
    strongest = loadings.select("Feature", component).orderBy(F.abs(component).desc(), "Feature").limit(top_n)
    return strongest.orderBy(component, "Feature")
