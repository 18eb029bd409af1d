"""Screening, design statistics, alignment, scoring, ranking and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.registry import query, rounded
from query_suite.sequences import KEYS, KEYS_SQL, described, descriptor_cte, tagged, valid_rows
from residua.functions import constants as K
from residua.functions.descriptors import with_descriptors
from residua.operators import design as D
from residua.operators import metrics as M
from residua.operators import scoring as R
from residua.operators import screening as C
from residua.operators.storage import materialize

FEATURES = list(K.DEFAULT_CRITERIA)
PASS = [f"Pass_{f}" for f in FEATURES]
RESULT = ["CriteriaPassCount", "CriteriaTotal", "StructureQualityScore", "StructureAssessment"]

_PASS_SQL = ", ".join(
    f'CAST("{f}" BETWEEN {low} AND {high} AS BIGINT) AS "Pass_{f}"' for f, (low, high) in K.DEFAULT_CRITERIA.items()
)
_COUNT_SQL = " + ".join(f'"{p}"' for p in PASS)
_LABEL_SQL = (
    "CASE " + " ".join(f"WHEN quality >= {low} THEN '{name}'" for low, name in K.ASSESSMENTS)
    + f" ELSE '{K.LOWEST_ASSESSMENT}' END"
)
SCREEN_SQL = descriptor_cte(FEATURES) + f""",
  flagged AS (SELECT *, {_PASS_SQL} FROM described),
  counted AS (SELECT *, CAST({_COUNT_SQL} AS BIGINT) AS "CriteriaPassCount", CAST({len(PASS)} AS BIGINT) AS "CriteriaTotal" FROM flagged),
  scored AS (SELECT *, "CriteriaPassCount" * 100.0 / {len(PASS)} AS quality FROM counted),
  screened AS (SELECT * EXCLUDE (quality), CAST(quality AS DOUBLE) AS "StructureQualityScore", {_LABEL_SQL} AS "StructureAssessment" FROM scored)"""
RESULT_SQL = ", ".join(f'"{c}"' for c in PASS + RESULT)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_screening(described(spark, sf_dir, FEATURES))


@query(f"{SCREEN_SQL} SELECT {KEYS_SQL}, {RESULT_SQL} FROM screened")
def criteria_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screened(spark, sf_dir).select(*KEYS, *PASS, *RESULT))


@query(f"""{SCREEN_SQL} SELECT round(avg("StructureQualityScore"), 6) AS "MeanStructureQualityScore",
           median("StructureQualityScore") AS "MedianStructureQualityScore",
           count(*) FILTER ("StructureQualityScore" >= 70) AS "HighQualityCount" FROM screened""")
def criteria_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.screening_summary(screened(spark, sf_dir)))


@query(f"""{SCREEN_SQL}, edges AS (SELECT min("StructureQualityScore") AS lo, max("StructureQualityScore") AS hi FROM screened),
           placed AS (SELECT CASE WHEN hi > lo THEN least(floor(("StructureQualityScore" - lo) / ((hi - lo) / 20)), 19) ELSE 0 END AS b,
                             lo, (hi - lo) / 20 AS w, "StructureAssessment" FROM screened, edges)
           SELECT CAST(b AS BIGINT) AS bin, round(lo + b * w, 6) AS bin_start, "StructureAssessment", count(*) AS "rows" FROM placed GROUP BY b, lo, w, "StructureAssessment" """)
def criteria_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.score_histogram(screened(spark, sf_dir)))


@query(f"""{SCREEN_SQL}, best AS (SELECT * FROM screened ORDER BY "StructureQualityScore" DESC, row_id, l_partkey, l_suppkey LIMIT 1)
           SELECT replace("Criterion", 'Pass_', '') AS "Criterion", "Passed" FROM (SELECT {', '.join(f'"{p}"' for p in PASS)} FROM best)
           UNPIVOT ("Passed" FOR "Criterion" IN ({', '.join(f'"{p}"' for p in PASS)}))""")
def criteria_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.with_rank(screened(spark, sf_dir), KEYS, "StructureQualityScore")
    return rounded(C.criteria_vector(ranked, F.col("Rank") == 1))


@query(SCREEN_SQL + f""", first_rows AS (SELECT * FROM screened
           QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY row_id, l_partkey, l_suppkey, activity) = 1)
           SELECT row_number() OVER (ORDER BY "StructureQualityScore" DESC, sequence) AS "Rank", row_id, sequence,
                  round("Gravy", 6) + 0.0 AS "Gravy", "StructureQualityScore", "StructureAssessment" FROM first_rows""")
def screened_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, validate, keep first, describe, screen, rank: the main path from end to end."""
    first = tagged(spark, sf_dir).valid
    scored = C.with_screening(with_descriptors(first, "sequence", only=FEATURES))
    ranked = R.with_rank(scored, ["Sequence"], "StructureQualityScore")
    return rounded(ranked.select("Rank", "row_id", F.col("Sequence").alias("sequence"), "Gravy", "StructureQualityScore", "StructureAssessment"))


EFFECTS_SQL = f"""WITH {I.CLEAN_SQL}, overall AS (SELECT count(*) AS n, avg(activity) AS mean, stddev_pop(activity) AS sd FROM valid),
  letters AS (SELECT activity, i AS pos, substr(sequence, i, 1) AS aa FROM (SELECT activity, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM valid) WHERE i <= 60),
  indicator AS (SELECT p.pos, p.aa, count(*) AS c, avg(l.activity) AS m FROM (SELECT DISTINCT pos, aa FROM letters) p JOIN letters l USING (pos, aa) GROUP BY p.pos, p.aa HAVING count(*) >= 2),
  with_corr AS (SELECT pos, aa, c, m, m - mean AS delta,
       CASE WHEN c < n AND sd > 0 THEN (c / n * m - c / n * mean) / (sqrt(c / n * (1 - c / n)) * sd) END AS r
       FROM indicator, overall)"""


def _effects_sql(sign: str, direction: str) -> str:
    return EFFECTS_SQL + f""", effects AS (SELECT CAST(pos AS BIGINT) AS "Position", aa AS "Residue", c AS "Count", m AS "MeanTarget", delta AS "DeltaFromMean",
       r AS "Correlation", {sign}delta AS "DesignScore", '{direction}' AS "Direction" FROM with_corr)"""


def _assay(spark: SparkSession, sf_dir: str, target: str = "activity") -> DataFrame:
    return valid_rows(spark, sf_dir).withColumnRenamed("activity", target)


@query(_effects_sql("", "maximize") + """ SELECT "Position", "Residue", "Count", round("MeanTarget", 4) + 0.0 AS "MeanTarget", round("DeltaFromMean", 4) + 0.0 AS "DeltaFromMean",
       round("Correlation", 6) + 0.0 AS "Correlation", round("DesignScore", 4) + 0.0 AS "DesignScore", "Direction" FROM effects""")
def position_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = D.analyze_positions(_assay(spark, sf_dir), "sequence", "activity").effects
    return rounded(effects.withColumn("Correlation", F.round("Correlation", 6) + 0.0), 4, ["Correlation"])


@query(f"""WITH {I.CLEAN_SQL}, letters AS (SELECT l.activity, p.pos, p.aa, CASE WHEN substr(l.sequence, p.pos, 1) = p.aa THEN 1.0 ELSE 0.0 END AS hit
           FROM (SELECT DISTINCT i AS pos, substr(sequence, i, 1) AS aa FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS i FROM valid)) p, valid l)
           SELECT CAST(pos AS BIGINT) AS "Position", aa AS "Residue", round(corr(hit, activity), 6) + 0.0 AS "Correlation" FROM letters GROUP BY pos, aa HAVING sum(hit) >= 2""")
def position_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed-form correlation against the plain indicator form."""
    effects = D.position_effects(_assay(spark, sf_dir), "sequence", "activity")
    return rounded(effects.select("Position", "Residue", "Correlation"))


@query(_effects_sql("-", "minimize") + """, best AS (SELECT * FROM effects QUALIFY row_number() OVER (PARTITION BY "Position" ORDER BY "DesignScore" DESC, "Count" DESC, "Residue") = 1),
       worst AS (SELECT * FROM effects QUALIFY row_number() OVER (PARTITION BY "Position" ORDER BY "DesignScore", "Count" DESC, "Residue") = 1)
       SELECT "Position", b."Residue" AS "RecommendedResidue", w."Residue" AS "AvoidResidue", round(b."MeanTarget", 4) AS "RecommendedMeanTarget",
              round(w."MeanTarget", 4) AS "AvoidMeanTarget", round(b."Correlation", 6) AS "RecommendedCorrelation", b."Count" AS "EvidenceCount", b."Direction",
              'Position ' || "Position" || ' favors ' || b."Residue" || ' (IC50 mean ' || printf('%.3g', b."MeanTarget") || '); avoid ' || w."Residue" || ' when evidence is consistent.' AS "Suggestion"
       FROM best b JOIN worst w USING ("Position")""")
def position_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.analyze_positions(_assay(spark, sf_dir, "IC50"), "sequence", "IC50").recommendations
    return rounded(found.withColumn("RecommendedCorrelation", F.round("RecommendedCorrelation", 6)), 4, ["RecommendedCorrelation"])


_MEMBERS_SQL = "members(cls, aa) AS (VALUES " + ", ".join(f"('{c}', '{aa}')" for c, letters in K.RESIDUE_CLASSES.items() for aa in letters) + ")"


@query(_effects_sql("-", "minimize").replace("WITH ", f"WITH {_MEMBERS_SQL}, ", 1) + """ SELECT "Position", cls AS "ResidueClass", "Direction",
       round(sum("DesignScore" * "Count") / sum("Count"), 4) + 0.0 AS "WeightedDesignScore", CAST(sum("Count") AS BIGINT) AS "TotalEvidenceCount"
       FROM effects JOIN members ON aa = "Residue" GROUP BY "Position", cls, "Direction" """)
def class_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.analyze_positions(_assay(spark, sf_dir, "IC50"), "sequence", "IC50").classes, 4)


HEATMAP_POSITIONS = 22


@query(_effects_sql("", "maximize") + ' SELECT "Residue", ' + ", ".join(
    f"""round(avg("DesignScore") FILTER ("Position" = {p}), 4) + 0.0 AS "P{p}" """ for p in range(1, HEATMAP_POSITIONS + 1)) + ' FROM effects GROUP BY "Residue"')
def position_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = D.position_effects(_assay(spark, sf_dir), "sequence", "activity")
    return rounded(D.position_heatmap(effects, HEATMAP_POSITIONS), 4)


@query(_effects_sql("", "maximize") + f""", recs AS (SELECT "Position", "Residue" AS rec, "Count" AS evidence, "Correlation" AS r, "MeanTarget" AS m,
         row_number() OVER (ORDER BY "Position") AS place FROM effects QUALIFY row_number() OVER (PARTITION BY "Position" ORDER BY "DesignScore" DESC, "Count" DESC, "Residue") = 1),
       {I.PEP_SQL}
       SELECT pep_id, "Position", substr(sequence, CAST("Position" AS INT), 1) AS "CurrentResidue", rec AS "RecommendedResidue",
              CASE WHEN substr(sequence, CAST("Position" AS INT), 1) = rec THEN 'Keep' ELSE 'Consider mutation' END AS "Action",
              substr(sequence, 1, CAST("Position" AS INT) - 1) || rec || substr(sequence, CAST("Position" AS INT) + 1) AS "SuggestedSequence",
              evidence AS "EvidenceCount", round(r, 6) AS "RecommendedCorrelation"
       FROM pep JOIN recs ON "Position" <= length(sequence) QUALIFY row_number() OVER (PARTITION BY pep_id ORDER BY place) <= 12""")
def mutation_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = D.position_effects(_assay(spark, sf_dir), "sequence", "activity")
    recommendations = D.position_recommendations(effects, "activity")
    proposals = D.suggest_mutations(I.peptides(spark, sf_dir).select("pep_id", "sequence"), recommendations, "sequence", top_n=12)
    return rounded(proposals.drop("sequence", "Suggestion"))


_BEST_SQL = f"""WITH {I.CLEAN_SQL}, best AS (SELECT name AS "ReferenceName", sequence AS "ReferenceSequence", activity AS "ReferenceTarget"
       FROM valid ORDER BY activity DESC, row_id, l_partkey, l_suppkey LIMIT 1)"""


@query(f"{_BEST_SQL} SELECT * FROM best")
def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_rows(spark, sf_dir).withColumnRenamed("name", "Name")
    return D.best_reference(rows, "sequence", "activity", KEYS)


_ALIGN_SQL = _BEST_SQL + """, pairs AS (SELECT *, levenshtein("ReferenceSequence", sequence) AS d, greatest(length("ReferenceSequence"), length(sequence)) AS longest,
         len(list_filter(range(1, least(length("ReferenceSequence"), length(sequence)) + 1), lambda i: substr("ReferenceSequence", i, 1) = substr(sequence, i, 1))) AS shared,
         list_filter(list_transform(range(1, least(length("ReferenceSequence"), length(sequence)) + 1),
             lambda i: CASE WHEN substr("ReferenceSequence", i, 1) <> substr(sequence, i, 1) THEN substr("ReferenceSequence", i, 1) || i || substr(sequence, i, 1) END), lambda x: x IS NOT NULL) AS subs,
         length(sequence) - length("ReferenceSequence") AS diff FROM valid, best),
  noted AS (SELECT *, CASE WHEN diff > 0 THEN list_append(subs, '+' || diff || ' residue(s)') WHEN diff < 0 THEN list_append(subs, '-' || (-diff) || ' residue(s)') ELSE subs END AS changes FROM pairs),
  aligned AS (SELECT row_id, l_partkey, l_suppkey, name AS "Name", sequence AS "Sequence", activity AS "Target", "ReferenceName", "ReferenceSequence", "ReferenceTarget",
       round_even(shared / longest, 3) AS "SequenceIdentityToReference", round_even(1.0 - d / longest, 3) AS "EditSimilarityToReference", CAST(d AS BIGINT) AS "EditDistanceToReference",
       diff AS "LengthDifference", CASE WHEN len(changes) = 0 THEN 'Reference' ELSE array_to_string(changes[1:12], ', ') || CASE WHEN len(changes) > 12 THEN ' ...' ELSE '' END END AS "MutationSummaryVsReference" FROM noted)"""


def _aligned(spark: SparkSession, sf_dir: str, top_n: int | None = None) -> DataFrame:
    rows = valid_rows(spark, sf_dir).withColumnRenamed("name", "Name")
    return D.alignment_to_reference(rows, "sequence", "activity", KEYS, most_changes=12, top_n=top_n)


@query(f"{_ALIGN_SQL} SELECT * FROM aligned")
def alignment_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.sort_alignment(_aligned(spark, sf_dir), KEYS))


@query(f"""{_ALIGN_SQL} SELECT * FROM aligned ORDER BY "EditSimilarityToReference" DESC, "SequenceIdentityToReference" DESC, row_id, l_partkey, l_suppkey LIMIT 50""")
def alignment_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.sort_alignment(_aligned(spark, sf_dir, 50), KEYS, 50))


PROFILE = list(K.PROFILE_DESCRIPTORS)


@query(descriptor_cte(PROFILE) + """, cut AS (SELECT quantile_cont(activity, 0.75) AS t FROM described), best AS (SELECT described.* FROM described, cut WHERE activity >= t) """ + " UNION ALL ".join(
    f"""SELECT '{f}' AS "Criterion", round(quantile_cont(CAST("{f}" AS DOUBLE), 0.1), 6) + 0.0 AS "RangeLow", round(quantile_cont(CAST("{f}" AS DOUBLE), 0.9), 6) + 0.0 AS "RangeHigh",
        round(median(CAST("{f}" AS DOUBLE)), 6) + 0.0 AS "MedianInBestPeptides", 'maximize' AS "Direction",
        printf('%.3g', quantile_cont(CAST("{f}" AS DOUBLE), 0.1)) || ' to ' || printf('%.3g', quantile_cont(CAST("{f}" AS DOUBLE), 0.9)) AS "RecommendedRange" FROM best""" for f in PROFILE))
def design_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialize(described(spark, sf_dir, PROFILE).select("activity", *PROFILE), "descriptors")
    return rounded(D.design_profile(table, "activity", PROFILE).drop("Reason"), 6)


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in prediction for every valid row, computed the same way in both engines."""
    rows = valid_rows(spark, sf_dir).withColumn("Prediction", F.col("activity") * 0.9 + F.length("sequence"))
    return rows.select(*KEYS, "activity", "name", "sequence", "Prediction")


_PREDICTED_SQL = f"""WITH {I.CLEAN_SQL}, predicted AS (SELECT *, activity * 0.9 + length(sequence) AS p FROM valid),
  batch AS (SELECT min(p) AS lo, max(p) AS hi FROM predicted)"""


@query(f"""{_PREDICTED_SQL} SELECT {KEYS_SQL}, 'minimize' AS "OptimizationDirection", round(p, 6) AS "RawModelPrediction",
       round(100.0 * (hi - p) / (hi - lo), 6) AS "Prediction", round(100.0 * (hi - p) / (hi - lo), 6) AS "RankingScore",
       round(100.0 * (hi - p) / (hi - lo), 6) AS "NormalizedScore_0_100" FROM predicted, batch""")
def score_minimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_regression_scores(_predicted(spark, sf_dir), "IC50")
    return rounded(scored.drop("PredictionMeaning", "activity", "name", "sequence"))


@query(f"""{_PREDICTED_SQL} SELECT {KEYS_SQL}, 'maximize' AS "OptimizationDirection", round(p, 6) AS "Prediction", round(p, 6) AS "RankingScore",
       round(100.0 * (p - lo) / (hi - lo), 6) AS "NormalizedScore_0_100" FROM predicted, batch""")
def score_maximize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_regression_scores(_predicted(spark, sf_dir), "activity")
    return rounded(scored.drop("PredictionMeaning", "activity", "name", "sequence"))


_RANK_ORDER_SQL = "ORDER BY p DESC, row_id, l_partkey, l_suppkey, activity"


@query(f"""{_PREDICTED_SQL} SELECT row_number() OVER ({_RANK_ORDER_SQL}) AS "Rank", {KEYS_SQL}, round(p, 6) AS "RankingScore" FROM predicted""")
def rank_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_regression_scores(_predicted(spark, sf_dir), "activity")
    return rounded(R.with_rank(scored, I.ORDER).select("Rank", *KEYS, "RankingScore"))


@query(f"""{_PREDICTED_SQL} SELECT row_number() OVER ({_RANK_ORDER_SQL}) AS "Rank", {KEYS_SQL}, sequence, round(p, 6) AS "RankingScore" FROM predicted QUALIFY "Rank" <= 30""")
def top_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_regression_scores(_predicted(spark, sf_dir), "activity")
    ranked = R.with_rank(scored, I.ORDER)
    return rounded(R.top_predictions(ranked, 30).select("Rank", *KEYS, "sequence", "RankingScore"))


_JOIN_SQL = SCREEN_SQL + """, first_rows AS (SELECT * EXCLUDE (name), CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE name END AS "Name", activity * 0.9 + length(sequence) AS p FROM screened
       QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY row_id, l_partkey, l_suppkey, activity) = 1),
  ranked AS (SELECT *, row_number() OVER (ORDER BY p DESC, sequence) AS "Rank" FROM first_rows)"""


def _named_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tagged(spark, sf_dir).valid
    return first.select(
        F.when(F.col("l_partkey") % 3 != 0, F.col("name")).alias("Name"),
        F.col("sequence").alias("Sequence"),
        (F.col("activity") * 0.9 + F.length("sequence")).alias("RankingScore"),
    )


@query(f"""{_JOIN_SQL} SELECT "Rank", "Name", sequence AS "Sequence", round(p, 6) AS "RankingScore", {RESULT_SQL} FROM ranked""")
def predictions_with_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _named_first(spark, sf_dir)
    ranked = R.with_rank(first, ["Sequence"])
    screened_rows = C.with_screening(with_descriptors(first.select("Name", "Sequence"), only=FEATURES))
    return rounded(C.join_screening(ranked, screened_rows))


@query(f"""{_JOIN_SQL} SELECT "Rank", "Name", sequence AS "Sequence", {', '.join(f'round(CAST("{f}" AS DOUBLE), 6) + 0.0 AS "{f}"' if f != 'Length' else '"Length"' for f in FEATURES)}, {RESULT_SQL} FROM ranked""")
def criteria_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _named_first(spark, sf_dir)
    ranked = R.with_rank(first, ["Sequence"])
    screened_rows = C.with_screening(with_descriptors(first.select("Name", "Sequence"), only=FEATURES))
    return rounded(C.rank_screening(ranked, screened_rows))


@query(f"""{_PREDICTED_SQL}, m AS (SELECT avg(activity) AS mean FROM predicted)
       SELECT round(1 - sum(pow(activity - p, 2)) / sum(pow(activity - mean, 2)), 6) AS "R2", round(sqrt(avg(pow(activity - p, 2))), 4) AS "RMSE", round(avg(abs(activity - p)), 4) AS "MAE" FROM predicted, m""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.regression_metrics(_predicted(spark, sf_dir), "activity", "Prediction")
    return rounded(found.withColumn("R2", F.round("R2", 6)), 4, ["R2"])


@query(f"""{_PREDICTED_SQL} SELECT {KEYS_SQL}, activity, round(p, 6) AS "Prediction", round(activity - p, 6) + 0.0 AS residual FROM predicted""")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.residuals(_predicted(spark, sf_dir), "activity", "Prediction").drop("name", "sequence"))


@query(f"""{_PREDICTED_SQL} SELECT round(min(least(activity, p)), 6) AS low, round(max(greatest(activity, p)), 6) AS high FROM predicted""")
def axis_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.axis_bounds(_predicted(spark, sf_dir), "activity", "Prediction"))


_PER_CLASS_SQL = f"""WITH {I.LABELED_SQL}, classes AS (SELECT actual3 AS label FROM labeled UNION SELECT predicted3 FROM labeled),
  per_class AS (SELECT label, (SELECT count(*) FROM labeled WHERE actual3 = label AND predicted3 = label) AS hits,
                       (SELECT count(*) FROM labeled WHERE actual3 = label) AS support, (SELECT count(*) FROM labeled WHERE predicted3 = label) AS chosen FROM classes),
  rates AS (SELECT label, CASE WHEN chosen > 0 THEN hits / chosen ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r,
                   CASE WHEN hits > 0 THEN 2 * (hits / chosen) * (hits / support) / ((hits / chosen) + (hits / support)) ELSE 0 END AS f, support, hits FROM per_class)"""


@query(f"""{_PER_CLASS_SQL} SELECT round(sum(hits) / sum(support), 6) AS "Accuracy", round(sum(p * support) / sum(support), 6) AS "Precision",
       round(sum(r * support) / sum(support), 6) AS "Recall", round(sum(f * support) / sum(support), 6) AS "F1" FROM rates""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.classification_metrics(I.labeled(spark, sf_dir), "actual3", "predicted3"))


@query(f"""WITH {I.LABELED_SQL} SELECT CAST(position AS BIGINT) AS position, actual, count(*) FILTER (predicted3 = 'low') AS predicted_low, count(*) FILTER (predicted3 = 'mid') AS predicted_mid,
       count(*) FILTER (predicted3 = 'high') AS predicted_high FROM (VALUES (0, 'low'), (1, 'mid'), (2, 'high')) AS s(position, actual) LEFT JOIN labeled ON actual3 = actual GROUP BY position, actual""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.confusion_matrix(I.labeled(spark, sf_dir), "actual3", "predicted3", ["low", "mid", "high"]))


@query(f"""{_PER_CLASS_SQL}, acc AS (SELECT sum(hits) / sum(support) AS a, CAST(sum(support) AS BIGINT) AS s FROM rates)
       SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM rates
       UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), s FROM acc
       UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), any_value(s) FROM rates, acc
       UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), any_value(s) FROM rates, acc""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.classification_report(I.labeled(spark, sf_dir), "actual3", "predicted3"))


@query(f"""WITH {I.LABELED_SQL} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*), 6) + CAST(0 AS DOUBLE) AS "ROC_AUC"
       FROM labeled a JOIN labeled b ON a.quality = 1 AND b.quality = 0""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.roc_auc(I.labeled(spark, sf_dir), "quality", "score"))
