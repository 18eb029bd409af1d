"""Report sections, penalised regressions on uncorrelated components, scoring with screening, and the measurement table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.analysis import _LABEL_SQL, FEATURES, PASS, _PASS_SQL, _COUNT_SQL, _predicted, _PREDICTED_SQL, _RANK_ORDER_SQL
from query_suite.closed_forms import _FOLDS, _ROWS, _SCORES, _SPLIT, _WHOLE, CONFIG, LINEAR, PAIR, _fit_sql, _linear, _ridge, _table
from query_suite.features import PEP_SOURCE
from query_suite.files import _folder
from query_suite.registry import query, rounded
from query_suite.sequences import KEYS, KEYS_SQL, descriptor_cte
from residua.operators import scoring as R
from residua.operators.preprocessing import PreprocessingConfig
from residua.plans import report as REP
from residua.plans.bundle import ModelBundle
from residua.plans.prediction import predict_table
from residua.plans.stages import DescriptorPreprocessor
from residua.plans.training import train_and_compare
from residua.sources import readers as RD
from residua.sources import writers as WR


@query(f"""{_PREDICTED_SQL} SELECT row_number() OVER ({_RANK_ORDER_SQL}) AS "Rank", {KEYS_SQL}, round(p, 6) AS "RankingScore" FROM predicted QUALIFY "Rank" <= {REP.TOP_ROWS}""")
def report_best_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.with_rank(R.with_regression_scores(_predicted(spark, sf_dir), "activity"), I.ORDER)
    return rounded(REP.best_predictions(ranked).select("Rank", *KEYS, "RankingScore"))


@query(f"""{_FOLDS}, {_fit_sql("fit", "(SELECT * FROM z WHERE split = 'train')", "")},
  held AS (SELECT model, {_SCORES} FROM (SELECT model, y, ay + wg * (g - ag) + wc * (c - ac) AS p FROM z, fit WHERE split = 'test') GROUP BY model),
  cv AS (SELECT model, avg(r2) AS m FROM folds GROUP BY model), best AS (SELECT max_by(model, m) AS model FROM cv)
  SELECT 'leaderboard' AS section, model || ' R2' AS key, round(r2, 4) + 0.0 AS number, NULL AS value FROM held
  UNION ALL SELECT 'leaderboard', model || ' RMSE', round(rmse, 4) + 0.0, NULL FROM held UNION ALL SELECT 'leaderboard', model || ' PrimaryScore', round(m, 4) + 0.0, NULL FROM cv
  UNION ALL SELECT 'training', 'Model Trained', NULL, 'True' UNION ALL SELECT 'training', 'Models Compared', NULL, '2' UNION ALL SELECT 'training', 'Target Column', NULL, 'Outcome'
  UNION ALL SELECT 'training', 'Best Model', NULL, model FROM best UNION ALL SELECT 'training', 'Training Dataset Size', NULL, CAST(count(*) AS VARCHAR) FROM d""")
def report_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of models and its counters; numbers are compared as numbers."""
    result = _linear(spark, sf_dir, LINEAR, refit=False)
    board = REP.leaderboard_section(result.comparison, ["R2", "RMSE", "PrimaryScore"])
    board = board.select("section", "key", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("number"), F.lit(None).cast("string").alias("value"))
    counters = REP.training_summary(result, "Outcome").select("section", "key", F.lit(None).cast("double").alias("number"), "value")
    return board.unionByName(counters)


#: (absolute, squared) penalty of the models on standardised targets.
_PENALISED = "penalised(model, l1, l2) AS (VALUES ('Lasso', 0.001, 0.0), ('Elastic Net', 0.0005, 0.0005))"


@query(f"""{_SPLIT}, {_PENALISED}, r AS (SELECT sign(corr(g, c)) AS s, avg(y) AS my, stddev_pop(y) AS sy FROM z WHERE split = 'train'),
  pc AS (SELECT pep_id, split, y, (y - my) / sy AS t, (g + s * c) / sqrt(2) AS a, (g - s * c) / sqrt(2) AS b, my, sy FROM z, r),
  mm AS (SELECT avg(a * t) AS ta, avg(b * t) AS tb, avg(a * a) AS va, avg(b * b) AS vb FROM pc WHERE split = 'train'),
  w AS (SELECT model, sign(ta) * greatest(abs(ta) - l1, 0) / (va + l2) AS wa, sign(tb) * greatest(abs(tb) - l1, 0) / (vb + l2) AS wb FROM mm, penalised)
  SELECT model AS "Model", pep_id AS id, round(y, 4) + 0.0 AS y, round(my + sy * (wa * a + wb * b), 4) + 0.0 AS prediction FROM pc, w WHERE split = 'test'""")
def penalised_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasso and elastic net on two principal components, where soft thresholds solve them."""
    names = ["Lasso", "Elastic Net"]
    settings = PreprocessingConfig(use_pca=True, pca_components=2)
    found = train_and_compare(_table(spark, sf_dir), "Outcome", "regression", names, "pep_id", CONFIG, preprocessing=settings, folds=None, refit=False)
    out = None
    for name in names:
        rows = found.outputs[name].test.select(F.lit(name).alias("Model"), "id", "y", "prediction")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 4)


_SCREENED_ROWS = descriptor_cte(FEATURES, PEP_SOURCE) + f""", flagged AS (SELECT *, {_PASS_SQL} FROM described), screened AS (SELECT *, {_COUNT_SQL} AS n FROM flagged),
  d AS (SELECT pep_id, sequence, "Gravy" AS g, "NetCharge_pH7" AS c, "Gravy" * 2.0 + "NetCharge_pH7" * 0.5 + pep_id % 7 AS activity FROM described)"""


@query(_WHOLE.replace(_ROWS, _SCREENED_ROWS) + f""", p AS (SELECT pep_id, ay + wg * (g - ag) + wc * (c - ac) AS p FROM z, fit WHERE model = 'Ridge'), q AS (SELECT *, n * 100.0 / {len(PASS)} AS quality FROM screened JOIN p USING (pep_id))
  SELECT pep_id AS row_id, round(p, 2) + 0.0 AS "Prediction", {', '.join(f'"{x}"' for x in PASS)}, CAST(n AS BIGINT) AS "CriteriaPassCount", round(CAST(quality AS DOUBLE), 6) + 0.0 AS "StructureQualityScore", {_LABEL_SQL} AS "StructureAssessment" FROM q""")
def score_and_screen_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on two descriptors, save, load, then score, rank and screen all peptides."""
    path = _folder(spark, "bundle")
    _ridge(spark, sf_dir).save(spark, path)
    new = I.peptides(spark, sf_dir).select(F.col("pep_id").alias("row_id"), F.col("sequence").alias("Sequence"))
    found = predict_table(ModelBundle.load(spark, path), new).predictions
    found = found.select("row_id", "Prediction", *PASS, "CriteriaPassCount", "StructureQualityScore", "StructureAssessment")
    return rounded(found.withColumn("Prediction", F.round("Prediction", 2) + F.lit(0.0)))


@query(f"""{_WHOLE} SELECT pep_id, round(ay + wg * (g - ag) + wc * (c - ac), 3) + 0.0 AS prediction FROM z, fit WHERE model = 'Linear Regression'""")
def score_saved_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored pipeline of preprocessing and model, loaded by Spark's own reader, scores all peptides."""
    table, path = _table(spark, sf_dir), _folder(spark, "pipeline")
    stages = [DescriptorPreprocessor(inputCols=PAIR), LinearRegression(labelCol="Outcome", tol=1e-10)]
    Pipeline(stages=stages).fit(table).write().save(path)
    scored = PipelineModel.load(path).transform(table.select("pep_id", *PAIR))
    return scored.select("pep_id", (F.round("prediction", 3) + F.lit(0.0)).alias("prediction"))


_MEASURED = """SELECT concat('Pep_', lpad(cast(pep_id AS STRING), 6, '0')) AS Name, sequence AS Sequence, activity AS Activity, pep_id % 89 / 8.0 AS IC50,
  CASE WHEN pep_id % 3 = 0 THEN 'Low' WHEN pep_id % 3 = 1 THEN 'Medium' ELSE 'High' END AS ToxicityClass, CASE WHEN pep_id % 11 <> 0 THEN pep_id % 17 / 16.0 END AS Solubility,
  pep_id % 41 / 4.0 AS BindingScore, CASE WHEN pep_id % 2 = 0 THEN 'Active' ELSE 'Inactive' END AS ClassLabel, -(pep_id % 64) / 16.0 AS DockingScore FROM {pep}"""


@query(f"""WITH {I.PEP_SQL}, t AS ({_MEASURED.format(pep='pep').replace('AS STRING', 'AS VARCHAR')}) SELECT Name, Sequence, round(Activity, 6) + 0.0 AS Activity, IC50, ToxicityClass, Solubility, BindingScore, ClassLabel, round(DockingScore, 6) + 0.0 AS DockingScore FROM t""")
def measurement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measurement table with the nine columns of the fixed schema, written as CSV and read back."""
    path = _folder(spark, "measured")
    WR.write_csv(spark.sql(_MEASURED.format(pep="{src}"), src=I.peptides(spark, sf_dir)).repartition(4), path)
    return rounded(RD.read_csv(spark, path, schema=RD.MEASUREMENT_SCHEMA))
