"""Ranking scores of predictions and the global rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions.naming import scoring_direction
from residua.operators.ordering import with_row_number

# Output texts.
MINIMIZE_MEANING = (
    "Positive optimized score; higher is better. Raw lower-is-better value is in RawModelPrediction."
)
MAXIMIZE_MEANING = "Predicted target value; higher is better."


@dataclass(frozen=True)
class Batch:
    """Range and size of the values that are scored together."""

    low: float
    high: float
    n: int

    @property
    def flat(self) -> bool:
        return not self.n or abs(self.low - self.high) <= 1e-8 + 1e-5 * abs(self.high)


def batch_of(df: DataFrame, value: str) -> Batch:
    """Read once, so that the numbers stand in the score expressions as plain values."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    row = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n")).first()
    return Batch(row["low"], row["high"], row["n"])


def lower_better_score(value: Column, batch: Batch) -> Column:
    """Inverted min-max score from 0 to 100, exact at both ends; a batch without spread is scored value by value."""
    if batch.n > 1 and not batch.flat:
        score = F.lit(100.0) * ((F.lit(batch.high) - value) / F.lit(batch.high - batch.low))
    else:
        score = F.when(value <= 0, -value).otherwise(F.lit(100.0) / (F.lit(1.0) + value))
    return F.when(value.isNotNull(), F.greatest(score, F.lit(0.0)))


def normalized_score(value: Column, batch: Batch, higher_is_better: bool = True) -> Column:
    """Min-max score from 0 to 100 in either direction, exact at both ends; 100 for a batch without spread."""
    if batch.flat:
        return F.when(value.isNotNull(), F.lit(100.0))
    above = (value - F.lit(batch.low)) if higher_is_better else (F.lit(batch.high) - value)
    scaled = F.lit(100.0) * (above / F.lit(batch.high - batch.low))
    return F.when(value.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)))


def with_regression_scores(df: DataFrame, target: str, prediction: str = "Prediction") -> DataFrame:
    """Score columns of a regression batch, by the direction its target name implies."""
    direction = scoring_direction(target)
    batch = batch_of(df, prediction)
    raw = F.nanvl(F.col(prediction).cast("double"), F.lit(None).cast("double"))
    if direction == "minimize":
        columns = {
            "OptimizationDirection": F.lit(direction),
            "RawModelPrediction": raw,
            prediction: lower_better_score(raw, batch),
            "PredictionMeaning": F.lit(MINIMIZE_MEANING),
            "RankingScore": lower_better_score(raw, batch),
            "NormalizedScore_0_100": normalized_score(raw, batch, False),
        }
    else:
        columns = {
            "OptimizationDirection": F.lit(direction),
            "PredictionMeaning": F.lit(MAXIMIZE_MEANING),
            "RankingScore": raw,
            "NormalizedScore_0_100": normalized_score(raw, batch, True),
        }
    return df.withColumns(columns)


def with_class_scores(df: DataFrame, labels: Sequence[str], probability: str = "probability") -> DataFrame:
    """One `Prob_` column per class; the score is the second of two classes, else the highest."""
    p = F.col(probability)
    columns = {f"Prob_{label}": F.get(p, F.lit(i)) for i, label in enumerate(labels)}
    columns["RankingScore"] = F.get(p, F.lit(1)) if len(labels) == 2 else F.array_max(p)
    return df.withColumns(columns).drop(probability)


def with_rank(df: DataFrame, order: Sequence[Column | str], score: str = "RankingScore") -> DataFrame:
    """Rank 1..n by score, best first, missing scores last; ties follow the row order."""
    best_first = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).desc_nulls_last()
    ranked = with_row_number(df, [best_first, *[F.col(c) if isinstance(c, str) else c for c in order]], "Rank")
    return ranked.select("Rank", *[c for c in df.columns if c != "Rank"])


def top_predictions(ranked: DataFrame, top_n: int = 30) -> DataFrame:
    """The best rows of a ranked table, numbered 1..n."""
    return ranked.filter(F.col("Rank") <= top_n).orderBy("Rank")
