"""Score, rank and screen a table of sequences with a model bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from residua.functions.descriptors import with_descriptors
from residua.operators.scoring import with_class_scores, with_rank, with_regression_scores
from residua.operators.screening import with_screening
from residua.operators.storage import materialize
from residua.plans.bundle import ModelBundle


@dataclass(frozen=True)
class Scored:
    predictions: DataFrame
    descriptors: DataFrame


def predict_table(bundle: ModelBundle, df: DataFrame, id_col: str = "row_id", sequence_col: str = "Sequence") -> Scored:
    """Ranked predictions with screening columns, and the descriptor table behind them.

    Screening is computed on the same rows before ranking, so predictions and criteria need no join.
    """
    keep = [c for c in (id_col, "Name") if c in df.columns]
    descriptors = with_descriptors(df.select(*keep, sequence_col), sequence_col, bundle.descriptor_config)
    screened = materialize(with_screening(descriptors), "scoring")
    criteria = [c for c in screened.columns if c not in descriptors.columns]
    scored = bundle.apply(screened, [*keep, "Sequence", *criteria], id_col)
    if bundle.is_regression:
        scored = with_regression_scores(materialize(scored, "predicted"), bundle.target_column)
    elif "probability" in scored.columns:
        scored = with_class_scores(scored, bundle.labels)
    else:
        scored = scored.withColumn("RankingScore", F.lit(None).cast("double"))
    ranked = with_rank(scored, [id_col])
    front = ["Rank", *keep, "Sequence", "Prediction"]
    return Scored(
        ranked.select(*front, *[c for c in ranked.columns if c not in front and c not in criteria], *criteria),
        screened.select(*descriptors.columns),
    )
