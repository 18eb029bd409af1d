"""Position-level design statistics, best-reference alignment and mutation proposals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions import constants as K
from residua.functions.alignment import comparison, mutation_summary
from residua.functions.naming import resolve_direction
from residua.functions.numbers import format_significant, round_half_even
from residua.functions.sequences import clean_sequence, has_residues, residues, to_number
from residua.operators.quantiles import exact_quantiles
from residua.operators.storage import materialize


def measured(df: DataFrame, sequence_col: str, target_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cleaned non-empty sequences with a numeric target as (`Sequence`, `Target`)."""
    target = to_number(F.col(f"`{target_col}`"), dict(df.dtypes)[target_col])
    raw = F.col(f"`{sequence_col}`")
    return df.filter(has_residues(raw) & target.isNotNull()).select(
        *[F.col(f"`{c}`") for c in keep], clean_sequence(raw).alias("Sequence"), target.alias("Target")
    )


@dataclass(frozen=True)
class PositionAnalysis:
    effects: DataFrame
    recommendations: DataFrame
    classes: DataFrame


def position_effects(
    df: DataFrame,
    sequence_col: str,
    target_col: str,
    direction: str = "auto",
    min_count: int = 2,
    max_positions: int | None = None,
) -> DataFrame:
    """Count, mean, shift and correlation of the target for every residue at every position.

    All positions count unless a last one is given. One shuffle of at most positions x residues rows per task. The correlation of the 0/1 indicator
    with the target follows from group mean, overall mean and spread in closed form.
    """
    direction = resolve_direction(direction, target_col)
    rows = measured(df, sequence_col, target_col)
    overall = rows.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("Target").alias("mean"),
            F.stddev_pop("Target").alias("sd"),
            (F.min("Target") == F.max("Target")).alias("flat"),
        ).alias("o")
    ).scalar()
    letters = rows.select(
        "Target", F.posexplode(residues(F.col("Sequence") if max_positions is None else F.substring("Sequence", 1, max_positions))).alias("at", "Residue")
    ).filter(F.col("Residue").isin(*K.ALPHABET))
    grouped = (
        letters.groupBy((F.col("at") + 1).alias("Position"), "Residue")
        .agg(F.count("*").alias("Count"), F.avg("Target").alias("MeanTarget"))
        .filter(F.col("Count") >= min_count)
        .select("*", overall.alias("o"))
    )
    delta = F.col("MeanTarget") - F.col("o.mean")
    share = F.col("Count") / F.col("o.n")
    correlation = delta / F.col("o.sd") * F.sqrt(share / F.nullif(F.lit(1.0) - share, F.lit(0.0)))
    varies = ~F.col("o.flat") & (F.col("Count") < F.col("o.n"))
    return grouped.select(
        "Position",
        "Residue",
        "Count",
        "MeanTarget",
        delta.alias("DeltaFromMean"),
        F.when(varies, correlation).alias("Correlation"),
        (delta if direction == "maximize" else -delta).alias("DesignScore"),
        F.lit(direction).alias("Direction"),
    )


def position_recommendations(effects: DataFrame, target_col: str) -> DataFrame:
    """Best and worst residue of every position: by score, then evidence, then residue."""
    payload = [F.col(c) for c in ("MeanTarget", "Correlation", "Count")]
    best = F.min(F.struct((-F.col("DesignScore")).alias("a"), (-F.col("Count")).alias("b"), "Residue", *payload))
    worst = F.min(F.struct(F.col("DesignScore").alias("a"), (-F.col("Count")).alias("b"), "Residue", *payload))
    picked = effects.groupBy("Position", "Direction").agg(best.alias("best"), worst.alias("worst"))
    # The parts of the sentence.
    sentence = F.concat(
        F.lit("Position "), F.col("Position").cast("string"), F.lit(" favors "), F.col("best.Residue"),
        F.lit(f" ({target_col} mean "), format_significant(F.col("best.MeanTarget")),
        F.lit("); avoid "), F.col("worst.Residue"), F.lit(" when evidence is consistent."),
    )
    return picked.select(
        "Position",
        F.col("best.Residue").alias("RecommendedResidue"),
        F.col("worst.Residue").alias("AvoidResidue"),
        F.col("best.MeanTarget").alias("RecommendedMeanTarget"),
        F.col("worst.MeanTarget").alias("AvoidMeanTarget"),
        F.col("best.Correlation").alias("RecommendedCorrelation"),
        F.col("best.Count").alias("EvidenceCount"),
        "Direction",
        sentence.alias("Suggestion"),
    ).orderBy("Position")


def class_recommendations(effects: DataFrame) -> DataFrame:
    """Evidence-weighted mean score of every residue class at every position."""
    members = effects.sparkSession.createDataFrame(
        [(name, aa) for name, letters in K.RESIDUE_CLASSES.items() for aa in letters],
        "ResidueClass string, Member string",
    )
    joined = effects.join(F.broadcast(members), F.col("Residue") == F.col("Member"))  # fixed small table
    weighted = F.sum(F.col("DesignScore") * F.col("Count")) / F.sum("Count")
    return (
        joined.groupBy("Position", "ResidueClass", "Direction")
        .agg(weighted.alias("WeightedDesignScore"), F.sum("Count").alias("TotalEvidenceCount"))
        .orderBy("Position", F.col("WeightedDesignScore").desc(), "ResidueClass")
    )


def analyze_positions(
    df: DataFrame,
    sequence_col: str,
    target_col: str,
    direction: str = "auto",
    min_count: int = 2,
    max_positions: int | None = None,
) -> PositionAnalysis:
    """The three tables over effects that are computed once (at most positions x residues rows)."""
    effects = materialize(position_effects(df, sequence_col, target_col, direction, min_count, max_positions), "effects")
    return PositionAnalysis(
        effects.orderBy("Position", F.col("DesignScore").desc(), "Residue"),
        position_recommendations(effects, target_col),
        class_recommendations(effects),
    )


def position_heatmap(effects: DataFrame, positions: int, value: str = "DesignScore") -> DataFrame:
    """Residue by position pivot of the mean value; `P<n>` columns, null without evidence."""
    wanted = list(range(1, positions + 1))
    pivoted = effects.groupBy("Residue").pivot("Position", wanted).avg(value)
    return pivoted.select("Residue", *[F.col(f"`{p}`").alias(f"P{p}") for p in wanted]).orderBy("Residue")


def suggest_mutations(
    candidates: DataFrame, recommendations: DataFrame, sequence_col: str = "Sequence", top_n: int | None = None
) -> DataFrame:
    """Proposals for every candidate, at the recommended positions it has; only the first `top_n` if given.

    The recommendations are a table of at most one row per analysed position, so they are broadcast
    and each candidate is only spread over those positions. Since the list goes up by position, the
    first proposals of a candidate are the first rows of the list: no ranking per candidate.
    """
    listed = recommendations.select(
        F.col("Position").alias("__position"),
        "RecommendedResidue", "EvidenceCount", "RecommendedCorrelation", "Suggestion",
    )
    wanted = listed.select("__position").orderBy("__position")
    last = (wanted if top_n is None else wanted.limit(top_n)).agg(F.max("__position")).first()[0] or 0
    sequence = F.col("__sequence")
    spread = (
        candidates.withColumn("__sequence", clean_sequence(F.col(f"`{sequence_col}`")))
        .select("*", F.posexplode(F.slice(residues(sequence), 1, last)).alias("__at", "CurrentResidue"))
        .withColumn("Position", F.col("__at") + 1)
    )
    joined = spread.join(F.broadcast(listed), F.col("Position") == F.col("__position"))
    same = F.col("CurrentResidue") == F.col("RecommendedResidue")
    mutated = F.overlay(sequence, F.col("RecommendedResidue"), F.col("Position"), F.lit(1))
    return joined.select(
        *[F.col(f"`{c}`") for c in candidates.columns],
        "Position",
        "CurrentResidue",
        "RecommendedResidue",
        F.when(same, "Keep").otherwise("Consider mutation").alias("Action"),
        mutated.alias("SuggestedSequence"),
        "EvidenceCount",
        "RecommendedCorrelation",
        "Suggestion",
    )


def best_reference(
    df: DataFrame, sequence_col: str, target_col: str, order: Sequence[str], direction: str = "auto"
) -> DataFrame:
    """One row: the peptide with the best target, the first in row order among equals."""
    direction = resolve_direction(direction, target_col)
    keep = [*order] + (["Name"] if "Name" in df.columns else [])
    rows = measured(df, sequence_col, target_col, keep)
    badness = -F.col("Target") if direction == "maximize" else F.col("Target")
    name = F.col("Name") if "Name" in df.columns else F.lit("Best reference")
    first = rows.agg(
        F.min(F.struct(badness.alias("a"), *order, "Sequence", "Target", name.alias("ReferenceName"))).alias("r")
    )
    return first.select(
        "r.ReferenceName",
        F.col("r.Sequence").alias("ReferenceSequence"),
        F.col("r.Target").alias("ReferenceTarget"),
    )


def alignment_to_reference(
    df: DataFrame, sequence_col: str, target_col: str, order: Sequence[str], direction: str = "auto",
    most_changes: int | None = None, top_n: int | None = None,
) -> DataFrame:
    """Every peptide against the best observed one, row-local; no pair of peptides is formed.

    The rows are unsorted; `sort_alignment` puts them in report order. With `top_n` only the rows that it would keep are
    returned, and only they get a summary of their changes.
    """
    reference = best_reference(df, sequence_col, target_col, order, direction)
    chosen = reference.select(F.struct("*")).scalar()
    name = F.col("Name") if "Name" in df.columns else F.lit("")
    target = to_number(F.col(f"`{target_col}`"), dict(df.dtypes)[target_col])
    raw = F.col(f"`{sequence_col}`")
    rows = df.filter(has_residues(raw)).select(
        *order, name.alias("Name"), clean_sequence(raw).alias("Sequence"), target.alias("Target"), chosen.alias("__r")
    )
    best, seq = F.col("__r.ReferenceSequence"), F.col("Sequence")
    longest = F.greatest(F.length(best), F.length(seq), F.lit(1))
    compared = rows.select("*", comparison(best, seq).alias("__found"))
    edit_share = F.lit(1.0) - F.col("EditDistanceToReference") / longest
    measured_rows = compared.withColumn("EditDistanceToReference", F.col("__found.distance")).withColumns({
        "SequenceIdentityToReference": round_half_even(F.col("__found.shared") / longest, 3),
        "EditSimilarityToReference": round_half_even(edit_share, 3),
    })
    if top_n is not None:
        measured_rows = materialize(sort_alignment(measured_rows, order, top_n), "first")  # few rows; a summary for every row would cost most
    return measured_rows.select(
        *order, "Name", "Sequence", "Target",
        F.col("__r.ReferenceName").alias("ReferenceName"),
        best.alias("ReferenceSequence"),
        F.col("__r.ReferenceTarget").alias("ReferenceTarget"),
        "SequenceIdentityToReference",
        "EditSimilarityToReference",
        "EditDistanceToReference",
        (F.length(seq) - F.length(best)).alias("LengthDifference"),
        mutation_summary(best, seq, most_changes).alias("MutationSummaryVsReference"),
    )


def sort_alignment(aligned: DataFrame, order: Sequence[str], top_n: int | None = None) -> DataFrame:
    """Most similar first; with `top_n` only that many rows per task are kept for the merge."""
    ranked = aligned.orderBy(
        F.col("EditSimilarityToReference").desc(), F.col("SequenceIdentityToReference").desc(), *order
    )
    return ranked if top_n is None else ranked.limit(top_n)


def design_profile(
    df: DataFrame, target_col: str, descriptors: Sequence[str], direction: str = "auto"
) -> DataFrame:
    """10th to 90th percentile and median of key descriptors among the best quarter of the peptides."""
    direction = resolve_direction(direction, target_col)
    best_share = 0.75 if direction == "maximize" else 0.25
    threshold = exact_quantiles(df, [target_col], [best_share])[target_col].values[best_share]
    schema = "Criterion string, RangeLow double, RangeHigh double, RecommendedRange string, MedianInBestPeptides double, Direction string, Reason string"
    wanted = [d for d in K.PROFILE_DESCRIPTORS if d in descriptors and d in df.columns]
    if threshold is None or not wanted:
        return df.sparkSession.createDataFrame([], schema)
    target = to_number(F.col(f"`{target_col}`"), dict(df.dtypes)[target_col])
    best = df.filter(target >= threshold if direction == "maximize" else target <= threshold)
    spread = exact_quantiles(best, wanted, [0.1, 0.5, 0.9])
    # Fixed value: output text.
    reason = "Observed range among the best-activity peptides in this dataset."
    rows = []
    for name in wanted:
        found = spread[name]
        if found.count:
            low, median, high = (float(found.values[p]) for p in (0.1, 0.5, 0.9))
            rows.append((name, low, high, f"{low:.3g} to {high:.3g}", median, direction, reason))
    return df.sparkSession.createDataFrame(rows, schema)
