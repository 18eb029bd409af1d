"""Regression and classification metrics as aggregations, optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from residua.operators.ordering import with_running_total


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE and MAE; a constant target has R2 1 if it is met exactly, else 0."""
    y, p = F.col(actual), F.col(predicted)
    sums = df.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.sum((y - p) * (y - p)).alias("sse"),
        F.var_pop(y).alias("var"),
        (F.min(y) == F.max(y)).alias("flat"),
        F.avg(F.abs(y - p)).alias("MAE"),
    )
    r2 = F.when(F.col("flat"), F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(
        F.lit(1.0) - F.col("sse") / F.nullif(F.col("var") * F.col("n"), F.lit(0.0))
    )
    return sums.select(
        *group,
        F.when(F.col("n") >= 2, r2).alias("R2"),
        F.sqrt(F.col("sse") / F.nullif(F.col("n"), F.lit(0))).alias("RMSE"),
        "MAE",
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def axis_bounds(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: lowest and highest value over actual and predicted."""
    return df.agg(
        F.min(F.least(actual, predicted)).alias("low"), F.max(F.greatest(actual, predicted)).alias("high")
    )


def confusion_counts(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(
        *group, F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")
    ).agg(F.count("*").alias("n"))


def class_metrics(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as actual or predicted."""
    hit = F.col("actual") == F.col("predicted")
    sides = counts.select(
        *group,
        "n",
        F.when(hit, F.col("n")).otherwise(0).alias("hits"),
        F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("is_actual")),
                          F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_actual")))).alias("s"),
    )
    per_class = sides.groupBy(*group, F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.is_actual"), F.col("hits")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("s.is_actual"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.is_actual"), F.col("n")).otherwise(0)).alias("chosen"),
    )
    return per_class.select(
        *group,
        "label",
        _ratio(F.col("hits"), F.col("chosen")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2.0 * F.col("hits"), F.col("support") + F.col("chosen")).alias("f1_score"),
        "support",
        "hits",
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    classes = class_metrics(confusion_counts(df, actual, predicted, group), group)

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / F.sum("support")

    return classes.groupBy(*group).agg(
        (F.sum("hits") / F.sum("support")).alias("Accuracy"),
        weighted("precision").alias("Precision"),
        weighted("recall").alias("Recall"),
        weighted("f1_score").alias("F1"),
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row per label in the given order, one count column per predicted label."""
    texts = [str(label) for label in labels]
    counts = confusion_counts(df, actual, predicted).groupBy("actual").pivot("predicted", texts).sum("n")
    counts = counts.select(F.col("actual").alias("__actual"), *[F.col(f"`{t}`") for t in texts])
    spine = df.sparkSession.createDataFrame(list(enumerate(texts)), "position int, actual string")
    return spine.join(counts, F.col("actual") == F.col("__actual"), "left").select(
        "position", "actual", *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("bigint").alias(f"predicted_{t}") for t in texts]
    ).orderBy("position")


def classification_report(df: DataFrame, actual: str, predicted: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Per-class metrics followed by accuracy, plain average and support-weighted average."""
    classes = class_metrics(confusion_counts(df, actual, predicted))
    if labels is not None:
        spine = df.sparkSession.createDataFrame([(str(label),) for label in labels], "wanted string")
        classes = spine.join(classes, F.col("wanted") == F.col("label"), "left").select(
            F.col("wanted").alias("label"),
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1_score")],
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("support", "hits")],
        )
    names = ("precision", "recall", "f1_score")
    totals = classes.agg(
        (F.sum("hits") / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias(f"weighted_{c}") for c in names],
        F.sum("support").alias("support"),
    )

    def row(label: str, values: list[str]) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            *[F.col(v).alias(c) for v, c in zip(values, names)],
            F.col("support"),
        )

    summary = totals.select(
        F.explode(
            F.array(
                row("accuracy", ["accuracy"] * 3),
                row("macro avg", [f"macro_{c}" for c in names]),
                row("weighted avg", [f"weighted_{c}" for c in names]),
            )
        ).alias("r")
    ).select("r.*")
    return classes.drop("hits").unionByName(summary)


def roc_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null unless there are two actual classes.

    The second class in sorted order is the positive one. Rows are first counted per distinct
    score, so the ordered pass runs over distinct scores only.
    """
    label = F.col(actual).cast("string")
    present = df.filter(label.isNotNull() & F.col(score).isNotNull())
    classes = present.agg(
        F.struct(F.min(label).alias("low"), F.max(label).alias("high"), F.count_distinct(label).alias("k")).alias("c")
    ).scalar()
    per_score = present.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(label == classes["high"]).alias("pos"), F.count_if(label != classes["high"]).alias("neg")
    )
    running = with_running_total(per_score, [F.col("s")], "neg", "neg_to_here")
    beaten = (F.col("neg_to_here") - F.col("neg") / 2.0) * F.col("pos")
    pairs = running.agg(
        F.sum(beaten).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q")
    )
    area = F.col("wins") / F.nullif(F.col("p") * F.col("q").cast("double"), F.lit(0.0))
    return pairs.select(F.when(classes["k"] == 2, area).alias("ROC_AUC"))


def fold_summary(fold_metrics: DataFrame, metrics: Sequence[str], group: Sequence[str] = ("Model",)) -> DataFrame:
    """Mean and population standard deviation of fold metrics, named `CV_<metric>_mean` / `_std`."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(f"CV_{m}_mean"), F.stddev_pop(m).alias(f"CV_{m}_std")]
    return fold_metrics.groupBy(*group).agg(*columns)
