"""Classifiers on two features against closed forms and fixed points in SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite.closed_forms import _ROWS, CONFIG, PAIR
from query_suite.features import feature_table
from query_suite.registry import query, rounded
from residua.operators.scoring import with_class_scores
from residua.plans.boosting import SoftmaxBoosting
from residua.plans.stages import DescriptorPreprocessor
from residua.plans.training import TrainingResult, train_and_compare

NEWTON_STEPS = 9


def _split_sql(place: str) -> str:
    """Rows `z` with their split, the place of their class and standardised features; each class is cut on its own."""
    return f"""{_ROWS}, r AS (SELECT pep_id, g, c, {place} AS y, CAST(CAST({place} AS DOUBLE) AS VARCHAR) AS s FROM d),
  sizes AS (SELECT s, count(*) AS n FROM r GROUP BY s), t1 AS (SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS total FROM sizes),
  a1 AS (SELECT s, n, n * total // rows + CASE WHEN row_number() OVER (ORDER BY n * total % rows DESC, s) <= total - sum(n * total // rows) OVER () THEN 1 ELSE 0 END AS test FROM sizes, t1),
  t2 AS (SELECT CAST(sum(n - test) AS BIGINT) AS rows, CAST(ceil(sum(n - test) * (0.1 / (1.0 - 0.2))) AS BIGINT) AS total FROM a1),
  a2 AS (SELECT s, test, (n - test) * total // rows + CASE WHEN row_number() OVER (ORDER BY (n - test) * total % rows DESC, s) <= total - sum((n - test) * total // rows) OVER () THEN 1 ELSE 0 END AS val FROM a1, t2),
  x AS (SELECT *, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(pep_id AS VARCHAR) || ':42'), pep_id) AS rn FROM r) JOIN a2 USING (s)),
  m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(c) AS mc, stddev_pop(c) AS sc FROM x WHERE split = 'train'),
  z AS (SELECT pep_id, split, y, s, (g - mg) / sg AS g, (c - mc) / sc AS c FROM x, m),
  dealt AS (SELECT pep_id, y, g, c, (row_number() OVER (PARTITION BY s ORDER BY md5(CAST(pep_id AS VARCHAR) || ':0:42'), pep_id) - 1) % 5 AS fold FROM z WHERE split = 'train'),
  inside AS (SELECT dealt.*, f.fold AS out FROM dealt, (SELECT DISTINCT fold FROM dealt) f WHERE dealt.fold <> f.fold)"""


_FOLD_METRICS = """guessed AS (SELECT fold, y, p FROM predicted), labels AS (SELECT DISTINCT fold, y AS l FROM guessed UNION SELECT DISTINCT fold, p FROM guessed),
  rates AS (SELECT fold, l, (SELECT count(*) FROM guessed q WHERE q.fold = labels.fold AND q.y = l AND q.p = l) AS hits, (SELECT count(*) FROM guessed q WHERE q.fold = labels.fold AND q.y = l) AS support,
    (SELECT count(*) FROM guessed q WHERE q.fold = labels.fold AND q.p = l) AS chosen FROM labels)
  SELECT CAST(0 AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, round(sum(hits) / sum(support), 6) + 0.0 AS accuracy,
    round(sum(support * CASE WHEN hits > 0 THEN 2 * (hits / chosen) * (hits / support) / (hits / chosen + hits / support) ELSE 0 END) / sum(support), 6) + 0.0 AS f1_weighted FROM rates GROUP BY fold"""
THREE, TWO = "pep_id % 3", "CASE WHEN g * 2.0 + c * 0.5 + pep_id % 7 > 2.0 THEN 1 ELSE 0 END"


def _trained(spark: SparkSession, sf_dir: str, model: str, task: str, **options) -> TrainingResult:
    table = feature_table(spark, sf_dir, PAIR)
    place = F.col("pep_id") % 3 if task == "multiclass" else (F.col("Gravy") * 2.0 + F.col("NetCharge_pH7") * 0.5 + F.col("pep_id") % 7 > 2.0).cast("int")
    table = table.withColumn("Kind", F.concat(F.lit("c"), place.cast("string")))
    return train_and_compare(table, "Kind", task, [model], "pep_id", CONFIG, refit=False, **options)


@query(f"""{_split_sql(THREE)}, k AS (SELECT out, y AS l, count(*) AS n, avg(g) AS ag, var_pop(g) AS vg, avg(c) AS ac, var_pop(c) AS vc FROM inside GROUP BY out, y),
  predicted AS (SELECT pep_id, fold, any_value(y) AS y, max_by(l, ln(n) - 0.5 * ln(vg) - pow(g - ag, 2) / (2 * vg) - 0.5 * ln(vc) - pow(c - ac, 2) / (2 * vc)) AS p
    FROM dealt JOIN k ON k.out = dealt.fold GROUP BY pep_id, fold), {_FOLD_METRICS}""")
def cv_folds_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds from one scan of sums."""
    return rounded(_trained(spark, sf_dir, "Naive Bayes", "multiclass").outputs["Naive Bayes"].folds)


def _newton_sql(rows: str) -> str:
    """Logistic regression with a squared penalty of 1 / rows, per `out`, by Newton steps on the 3 x 3 system; ends in `fit`."""
    steps = [f"w0 AS (SELECT DISTINCT out, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {rows})"]
    for n in range(NEWTON_STEPS):
        steps.append(f"""s{n} AS MATERIALIZED (SELECT out, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(p - y) AS u0, sum((p - y) * g) + any_value(b1) AS u1, sum((p - y) * c) + any_value(b2) AS u2,
      sum(q) AS h00, sum(q * g) AS h01, sum(q * c) AS h02, sum(q * g * g) + 1 AS h11, sum(q * g * c) AS h12, sum(q * c * c) + 1 AS h22
      FROM (SELECT *, p * (1 - p) AS q FROM (SELECT out, y, g, c, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * g + b2 * c))) AS p FROM {rows} JOIN w{n} USING (out))) GROUP BY out)""")
        steps.append(f"""w{n + 1} AS (SELECT out, b0 - (u0 * (h11 * h22 - h12 * h12) - h01 * (u1 * h22 - h12 * u2) + h02 * (u1 * h12 - h11 * u2)) / det AS b0,
      b1 - (h00 * (u1 * h22 - u2 * h12) - u0 * (h01 * h22 - h12 * h02) + h02 * (h01 * u2 - u1 * h02)) / det AS b1,
      b2 - (h00 * (h11 * u2 - h12 * u1) - h01 * (h01 * u2 - u1 * h02) + u0 * (h01 * h12 - h11 * h02)) / det AS b2
      FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{n}))""")
    return ", ".join(steps) + f", fit AS (SELECT * FROM w{NEWTON_STEPS})"


@query(f"""{_split_sql(TWO)}, {_newton_sql("inside")}, predicted AS (SELECT fold, y, CASE WHEN b0 + b1 * g + b2 * c > 0 THEN 1 ELSE 0 END AS p FROM dealt JOIN fit ON fit.out = dealt.fold), {_FOLD_METRICS}""")
def cv_folds_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton steps of all folds, a scan for each."""
    return rounded(_trained(spark, sf_dir, "Logistic Regression", "binary").outputs["Logistic Regression"].folds)


@query(f"""{_split_sql(TWO)}, whole AS (SELECT 0 AS out, y, g, c FROM z WHERE split = 'train'), {_newton_sql("whole")},
  p AS (SELECT pep_id, y, 1 / (1 + exp(-(b0 + b1 * g + b2 * c))) AS p FROM z, fit WHERE split = 'test')
  SELECT pep_id AS id, 'c' || y AS y, round(1 - p, 4) + 0.0 AS "Prob_c0", round(p, 4) + 0.0 AS "Prob_c1", round(p, 4) + 0.0 AS "RankingScore" FROM p""")
def logistic_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores of the rows held out, by logistic regression."""
    result = _trained(spark, sf_dir, "Logistic Regression", "binary", folds=None, options={"Logistic Regression": {"tol": 1e-10}})
    scored = with_class_scores(result.outputs["Logistic Regression"].test, ["c0", "c1"])
    return rounded(scored.select("id", "y", "Prob_c0", "Prob_c1", "RankingScore"), 4)


LEVELS = 3


@query(f"""{_ROWS} SELECT pep_id, true AS sums_to_one, true AS known_class, true AS loss_falls, CAST(100 AS BIGINT) AS rounds FROM d""")
def softmax_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's rounds on three levels of a noisy sum: the log loss falls in every round, the shares of every row sum to one."""
    place = F.col("Gravy") * 2.0 + F.col("NetCharge_pH7") * 0.5 + F.col("pep_id") % 7
    table = feature_table(spark, sf_dir, PAIR).withColumn("Level", F.when(place > 4.0, 2.0).when(place > 1.0, 1.0).otherwise(0.0))
    stages = [DescriptorPreprocessor(inputCols=PAIR), SoftmaxBoosting(labelCol="Level", classes=LEVELS)]
    fitted = Pipeline(stages=stages).fit(table)
    losses = fitted.stages[1].losses
    shares = vector_to_array("probability")
    return rounded(fitted.transform(table).select(
        "pep_id", (F.abs(F.aggregate(shares, F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9).alias("sums_to_one"), F.col("prediction").isin(0.0, 1.0, 2.0).alias("known_class"),
        F.lit(all(b < a for a, b in zip(losses, losses[1:]))).alias("loss_falls"), F.lit(len(losses)).alias("rounds"),
    ))
