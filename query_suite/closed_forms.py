"""Models and components on two features, whose results have a closed form in SQL; and counted facts of the other models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.features import PEP_SOURCE, _cut_sql, feature_table
from query_suite.registry import query, rounded
from query_suite.sequences import descriptor_cte
from residua.functions.descriptors import DescriptorConfig
from residua.operators import decomposition as PCA
from residua.operators import validation as V
from residua.operators.scoring import with_class_scores
from residua.operators.storage import scratch_directory
from residua.plans import explanation as E
from residua.plans import report as REP
from residua.plans.bundle import ModelBundle
from residua.plans.prediction import predict_table
from residua.plans.training import TrainingResult, train_and_compare

CONFIG = DescriptorConfig(include_fingerprints=False, include_elemental=False)
PAIR = ["Gravy", "NetCharge_pH7"]
LINEAR = ["Linear Regression", "Ridge"]

_ROWS = descriptor_cte(PAIR, PEP_SOURCE) + """, d AS (SELECT pep_id, sequence, "Gravy" AS g, "NetCharge_pH7" AS c,
  "Gravy" * 2.0 + "NetCharge_pH7" * 0.5 + pep_id % 7 AS activity FROM described)"""
_SPLIT = f"""{_ROWS}, {_cut_sql("d", "first_cut", "0.2")}, left_over AS (SELECT pep_id, activity FROM first_cut WHERE NOT taken),
  {_cut_sql("left_over", "second_cut", "0.1 / (1.0 - 0.2)")},
  placed AS (SELECT pep_id, 'test' AS split FROM first_cut WHERE taken UNION ALL SELECT pep_id, CASE WHEN taken THEN 'val' ELSE 'train' END FROM second_cut),
  m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(c) AS mc, stddev_pop(c) AS sc FROM d JOIN placed USING (pep_id) WHERE split = 'train'),
  z AS (SELECT pep_id, split, (g - mg) / sg AS g, (c - mc) / sc AS c, activity AS y FROM d JOIN placed USING (pep_id), m)"""
_MODELS = "models(model, ridge) AS (VALUES ('Linear Regression', 0.0), ('Ridge', 1.0))"


def _fit_sql(name: str, rows: str, keys: str) -> str:
    """Least squares with a squared penalty of `ridge` / rows, by its 2 x 2 system, per model and key."""
    listed = f"model{', ' + keys if keys else ''}"
    return f"""{name}_s AS (SELECT {listed}, any_value(ridge) / count(*) AS l, avg(g) AS ag, avg(c) AS ac, avg(y) AS ay, var_pop(g) AS vg, var_pop(c) AS vc,
    covar_pop(g, c) AS gc, covar_pop(g, y) AS gy, covar_pop(c, y) AS cy FROM {rows}, models GROUP BY {listed}),
  {name} AS (SELECT *, (gy * (vc + l) - cy * gc) / ((vg + l) * (vc + l) - gc * gc) AS wg, (cy * (vg + l) - gy * gc) / ((vg + l) * (vc + l) - gc * gc) AS wc FROM {name}_s)"""


_SCORES = """1 - sum(pow(y - p, 2)) / nullif(count(*) * var_pop(y), 0) AS r2, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae"""
_FOLDS = f"""{_SPLIT}, {_MODELS}, dealt AS (SELECT pep_id, g, c, y, rep AS repeat, (row_number() OVER (PARTITION BY rep ORDER BY md5(CAST(pep_id AS VARCHAR) || ':' || rep || ':42'), pep_id) - 1) % 5 AS fold
    FROM z, (SELECT unnest(range(0, 5)) AS rep) WHERE split = 'train'),
  inside AS (SELECT dealt.*, f.fold AS out FROM dealt, (SELECT DISTINCT fold FROM dealt) f WHERE dealt.fold <> f.fold),
  {_fit_sql("fold_fit", "inside", "repeat, out")},
  tried AS (SELECT model, repeat, fold, y, ay + wg * (g - ag) + wc * (c - ac) AS p FROM dealt JOIN fold_fit USING (repeat) WHERE out = fold),
  folds AS (SELECT model, repeat, fold, {_SCORES} FROM tried GROUP BY model, repeat, fold)"""


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir, PAIR).withColumn("Outcome", F.col("Gravy") * 2.0 + F.col("NetCharge_pH7") * 0.5 + F.col("pep_id") % 7)


def _linear(spark: SparkSession, sf_dir: str, models: list[str], **options) -> TrainingResult:
    return train_and_compare(_table(spark, sf_dir), "Outcome", "regression", models, "pep_id", CONFIG, **options)


@query(f"""{_FOLDS}, {_fit_sql("fit", "(SELECT * FROM z WHERE split = 'train')", "")},
  held AS (SELECT model, {_SCORES} FROM (SELECT model, y, ay + wg * (g - ag) + wc * (c - ac) AS p FROM z, fit WHERE split = 'test') GROUP BY model),
  cv AS (SELECT model, avg(r2) AS m, stddev_pop(r2) AS s, avg(rmse) AS e, avg(mae) AS a FROM folds GROUP BY model)
  SELECT model AS "Model", round(r2, 4) + 0.0 AS "R2", round(rmse, 4) AS "RMSE", round(mae, 4) AS "MAE", round(m, 4) + 0.0 AS "CV_r2_mean", round(s, 4) AS "CV_r2_std",
    round(e, 4) AS "CV_root_mean_squared_error_mean", round(a, 4) AS "CV_mean_absolute_error_mean", round(m, 4) + 0.0 AS "PrimaryScore",
    round(greatest(0.0, least(100.0, 100.0 * m)), 2) AS "FitQuality_0_100" FROM held JOIN cv USING (model)""")
def compare_linear_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _linear(spark, sf_dir, LINEAR, refit=False).comparison
    names = ["R2", "RMSE", "MAE", "CV_r2_mean", "CV_r2_std", "CV_root_mean_squared_error_mean", "CV_mean_absolute_error_mean", "PrimaryScore"]
    return rounded(found.select("Model", *names, F.round("FitQuality_0_100", 2).alias("FitQuality_0_100")), 4, ["FitQuality_0_100"])


@query(f"""{_FOLDS} SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, round(r2, 4) + 0.0 AS r2, round(rmse, 4) AS root_mean_squared_error,
  round(mae, 4) AS mean_absolute_error FROM folds WHERE model = 'Ridge'""")
def cv_folds_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_linear(spark, sf_dir, ["Ridge"], refit=False).outputs["Ridge"].folds, 4)


_WHOLE = f"""{_ROWS}, {_MODELS}, m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(c) AS mc, stddev_pop(c) AS sc, stddev_pop(activity) AS sy FROM d),
  z AS (SELECT pep_id, sequence, (g - mg) / sg AS g, (c - mc) / sc AS c, activity AS y, sy FROM d, m), {_fit_sql("fit", "z", "")}"""


def _ridge(spark: SparkSession, sf_dir: str) -> ModelBundle:
    return _linear(spark, sf_dir, ["Ridge"], folds=2).outputs["Ridge"].bundle


@query(f"""{_WHOLE}, s AS (SELECT any_value(sy) AS sy FROM z)
  SELECT 'Gravy' AS "Feature", round(abs(wg / sy), 4) AS "Importance" FROM fit, s WHERE model = 'Ridge'
  UNION ALL SELECT 'NetCharge_pH7', round(abs(wc / sy), 4) FROM fit, s WHERE model = 'Ridge'""")
def importance_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.top_features(E.native_importance(_ridge(spark, sf_dir), spark)), 4)


@query(f"""{_WHOLE} SELECT 'Gravy' AS "Feature", round(avg(abs(wg * (g - ag))), 4) AS "MeanAbsAttribution" FROM z, fit WHERE model = 'Ridge'
  UNION ALL SELECT 'NetCharge_pH7', round(avg(abs(wc * (c - ac))), 4) FROM z, fit WHERE model = 'Ridge'""")
def attribution_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.attribution(_ridge(spark, sf_dir), _table(spark, sf_dir), "pep_id"), 4)


@query(f"""{_WHOLE}, p AS (SELECT pep_id, sequence, ay + wg * (g - ag) + wc * (c - ac) AS p FROM z, fit WHERE model = 'Ridge')
  SELECT pep_id AS row_id, sequence AS "Sequence", round(p, 3) + 0.0 AS "Prediction", round(100.0 * ((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ())), 2) + 0.0 AS "NormalizedScore_0_100",
    'maximize' AS "OptimizationDirection", abs(row_number() OVER (ORDER BY p DESC) - rank() OVER (ORDER BY p DESC)) < count(*) OVER () AS ranked FROM p""")
def score_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on all peptides, save, load, score and rank them; `ranked` tells that the rank follows the score."""
    path = f"{scratch_directory(spark)}/bundle-{uuid.uuid4().hex}"
    _ridge(spark, sf_dir).save(spark, path)
    new = I.peptides(spark, sf_dir).select(F.col("pep_id").alias("row_id"), F.col("sequence").alias("Sequence"))
    scored = predict_table(ModelBundle.load(spark, path), new).predictions
    before = scored.select((F.col("Rank") + 1).alias("Rank"), F.col("Prediction").alias("__before"))
    joined = scored.join(before, "Rank", "left")
    return joined.select(
        "row_id", "Sequence", (F.round("Prediction", 3) + 0.0).alias("Prediction"), (F.round("NormalizedScore_0_100", 2) + 0.0).alias("NormalizedScore_0_100"),
        "OptimizationDirection", F.coalesce(F.col("__before") >= F.col("Prediction"), F.col("Rank") == 1).alias("ranked"),
    )


_PCA = f"""{_ROWS}, m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(c) AS mc, stddev_pop(c) AS sc, corr(g, c) AS r FROM d),
  p AS (SELECT pep_id, ((g - mg) / sg + sign(r) * (c - mc) / sc) / sqrt(2) AS a, ((g - mg) / sg - sign(r) * (c - mc) / sc) / sqrt(2) AS b FROM d, m)"""


@query(f"""{_PCA} SELECT 'PC1' AS "Component", round((1 + abs(r)) / 2, 6) AS "ExplainedVarianceRatio", round((1 + abs(r)) / 2, 6) AS "CumulativeVarianceRatio" FROM m
  UNION ALL SELECT 'PC2', round((1 - abs(r)) / 2, 6), 1.0 FROM m""")
def pca_pair_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(PCA.pca_analysis(feature_table(spark, sf_dir, PAIR), PAIR, n_components=2).explained_variance)


@query("""SELECT f AS "Feature", round(1 / sqrt(2), 6) AS "PC1" FROM (VALUES ('Gravy'), ('NetCharge_pH7')) v(f)""")
def pca_pair_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign of a component is free, so magnitudes are compared."""
    found = PCA.top_loadings(PCA.pca_analysis(feature_table(spark, sf_dir, PAIR), PAIR, n_components=2).loadings)
    return rounded(found.select("Feature", F.abs("PC1").alias("PC1")))


@query(f"""{_PCA} SELECT pep_id, round(abs(a), 5) AS "PCA_1", round(abs(b), 5) AS "PCA_2" FROM p""")
def pca_pair_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PCA.embedding(feature_table(spark, sf_dir, PAIR), PAIR, ["pep_id"])
    return rounded(found.select("pep_id", F.abs("PCA_1").alias("PCA_1"), F.abs("PCA_2").alias("PCA_2")), 5)


CLASSES = ["c0", "c1", "c2"]
_CLASS_SPLIT = f"""{_ROWS}, r AS (SELECT pep_id, g, c, 'c' || pep_id % 3 AS label, CAST(CAST(pep_id % 3 AS DOUBLE) AS VARCHAR) AS s FROM d),
  sizes AS (SELECT s, count(*) AS n FROM r GROUP BY s), t1 AS (SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS total FROM sizes),
  a1 AS (SELECT s, n, n * total // rows + CASE WHEN row_number() OVER (ORDER BY n * total % rows DESC, s) <= total - sum(n * total // rows) OVER () THEN 1 ELSE 0 END AS test FROM sizes, t1),
  t2 AS (SELECT CAST(sum(n - test) AS BIGINT) AS rows, CAST(ceil(sum(n - test) * (0.1 / (1.0 - 0.2))) AS BIGINT) AS total FROM a1),
  a2 AS (SELECT s, test, (n - test) * total // rows + CASE WHEN row_number() OVER (ORDER BY (n - test) * total % rows DESC, s) <= total - sum((n - test) * total // rows) OVER () THEN 1 ELSE 0 END AS val FROM a1, t2),
  x AS (SELECT *, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(pep_id AS VARCHAR) || ':42'), pep_id) AS rn FROM r) JOIN a2 USING (s)),
  m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(c) AS mc, stddev_pop(c) AS sc FROM x WHERE split = 'train'),
  z AS (SELECT pep_id, split, label, (g - mg) / sg AS g, (c - mc) / sc AS c FROM x, m)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir, PAIR).withColumn("Kind", F.concat(F.lit("c"), (F.col("pep_id") % 3).cast("string")))


@query(f"""{_CLASS_SPLIT}, k AS (SELECT label, count(*) AS n, avg(g) AS ag, var_pop(g) AS vg, avg(c) AS ac, var_pop(c) AS vc FROM z WHERE split = 'train' GROUP BY label),
  l AS (SELECT pep_id, z.label AS y, k.label, ln(n) - 0.5 * ln(vg) - pow(g - ag, 2) / (2 * vg) - 0.5 * ln(vc) - pow(c - ac, 2) / (2 * vc) AS s FROM z, k WHERE split = 'test'),
  e AS (SELECT pep_id, y, label, exp(s - max(s) OVER (PARTITION BY pep_id)) AS e FROM l),
  p AS (SELECT pep_id, y, label, e / sum(e) OVER (PARTITION BY pep_id) AS p FROM e)
  SELECT pep_id AS id, y, {", ".join(f"round(max(p) FILTER (label = '{c}'), 5) AS \"Prob_{c}\"" for c in CLASSES)}, round(max(p), 5) AS "RankingScore" FROM p GROUP BY pep_id, y""")
def naive_bayes_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores of the rows held out, by Gaussian naive Bayes."""
    result = train_and_compare(_classes(spark, sf_dir), "Kind", "multiclass", ["Naive Bayes"], "pep_id", CONFIG, folds=None, refit=False)
    scored = with_class_scores(result.outputs["Naive Bayes"].test, CLASSES)
    return rounded(scored.select("id", "y", *[f"Prob_{c}" for c in CLASSES], "RankingScore"), 5)


SMALL = {
    "Random Forest": {"numTrees": 10, "maxDepth": 5}, "Extra Trees": {"numTrees": 10, "maxDepth": 5}, "Gradient Boosting": {"maxIter": 8},
    "SVR (RBF)": {"dimensions": 64, "maxIter": 30}, "SVM (RBF)": {"dimensions": 64}, "MLP Classifier": {"maxIter": 40},
}
TREES = ["Random Forest", "Gradient Boosting", "Extra Trees", "SVR (RBF)"]
CLASSIFIERS = ["Random Forest", "Gradient Boosting", "Extra Trees", "SVM (RBF)", "MLP Classifier"]


def _values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


@query(f"""{_SPLIT} SELECT n AS "Model", (SELECT count(*) FROM z WHERE split = 'test') AS rows, true AS better_than_mean, true AS finite FROM (VALUES {_values(TREES)}) v(n)""")
def regression_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row held out gets one finite prediction, and each family beats the mean."""
    table = _table(spark, sf_dir).withColumn("Outcome", F.col("Outcome") - F.col("pep_id") % 7 + (F.col("pep_id") % 7) / 10.0)
    split = _linear_outcome(table)
    facts = None
    for name, output in split.outputs.items():
        t = output.test
        row = t.agg(
            F.count("*").alias("rows"), (F.avg(F.pow(F.col("y") - F.col("prediction"), 2)) < F.var_pop("y")).alias("better_than_mean"),
            F.bool_and(F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("finite"),
        ).select(F.lit(name).alias("Model"), "*")
        facts = row if facts is None else facts.unionByName(row)
    return facts


def _linear_outcome(table: DataFrame) -> TrainingResult:
    return train_and_compare(table, "Outcome", "regression", TREES, "pep_id", CONFIG, folds=None, options=SMALL, refit=False)


DEFAULTS = ["Extra Trees", "SVR (RBF)"]


@query(f"""{_SPLIT} SELECT n AS "Model", pep_id AS id, round(y, 4) + 0.0 AS y, true AS finite, true AS better_than_mean FROM z, (VALUES {_values(DEFAULTS)}) v(n) WHERE split = 'test'""")
def learners_at_their_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's settings on the unchanged target: a prediction for every row held out, closer than the mean on the whole."""
    found = train_and_compare(_table(spark, sf_dir), "Outcome", "regression", DEFAULTS, "pep_id", CONFIG, folds=None, refit=False)
    out = None
    for name, output in found.outputs.items():
        facts = output.test.agg((F.avg(F.pow(F.col("y") - F.col("prediction"), 2)) < F.var_pop("y")).alias("better_than_mean"))
        rows = output.test.select(F.lit(name).alias("Model"), "id", "y", (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("finite"))
        rows = rows.join(F.broadcast(facts))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 4)


@query(f"""{_CLASS_SPLIT} SELECT n AS "Model", (SELECT count(*) FROM z WHERE split = 'test') AS rows, true AS probabilities_sum_to_one, true AS known_classes
  FROM (VALUES {_values(CLASSIFIERS)}) v(n)""")
def classifier_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row held out gets one class of the list and probabilities that sum to one."""
    result = train_and_compare(_classes(spark, sf_dir), "Kind", "multiclass", CLASSIFIERS, "pep_id", CONFIG, folds=None, options=SMALL, refit=False)
    facts = None
    for name, output in result.outputs.items():
        total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
        row = output.test.agg(
            F.count("*").alias("rows"), F.bool_and(F.abs(total - 1) < 1e-9).alias("probabilities_sum_to_one"),
            F.bool_and(F.col("prediction").isin(*CLASSES)).alias("known_classes"),
        ).select(F.lit(name).alias("Model"), "*")
        facts = row if facts is None else facts.unionByName(row)
    return facts


@query(f"""{descriptor_cte(PAIR, PEP_SOURCE)} SELECT pep_id, round("Gravy", 6) + 0.0 AS "Gravy", CAST(0.0 AS DOUBLE) AS "Absent", CAST(try_cast(CASE WHEN pep_id % 3 = 0 THEN 'x' ELSE CAST(pep_id AS VARCHAR) END AS DOUBLE) AS DOUBLE) AS "Text" FROM described""")
def align_to_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as a model wants them: an absent one filled, texts as numbers."""
    table = feature_table(spark, sf_dir, PAIR).withColumn("Text", F.when(F.col("pep_id") % 3 == 0, "x").otherwise(F.col("pep_id").cast("string")))
    return rounded(V.align_columns(table, ["pep_id"], ["Gravy", "Absent", "Text"]))


@query(f"""{_FOLDS}, {_fit_sql("fit", "(SELECT * FROM z WHERE split = 'train')", "")},
  held AS (SELECT {_SCORES} FROM (SELECT y, ay + wg * (g - ag) + wc * (c - ac) AS p FROM z, fit WHERE split = 'test' AND model = 'Ridge'))
  SELECT 'model' AS section, 'Model' AS key, 'Ridge' AS value UNION ALL SELECT 'model', 'Target', 'Outcome' UNION ALL SELECT 'model', 'Task', 'regression'
  UNION ALL SELECT 'model', 'Feature Count', '2' UNION ALL SELECT 'metrics', 'R2', printf('%.3f', r2) FROM held UNION ALL SELECT 'metrics', 'RMSE', printf('%.3f', rmse) FROM held
  UNION ALL SELECT 'metrics', 'MAE', printf('%.3f', mae) FROM held""")
def report_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = _linear(spark, sf_dir, ["Ridge"], folds=None).outputs["Ridge"].bundle
    return REP.model_summary(spark, bundle, ["R2", "RMSE", "MAE"], digits=3)
