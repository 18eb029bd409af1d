"""Feature importance and attribution of trained models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from residua.operators.ordering import hash_order, with_row_number
from residua.operators.storage import materialize
from residua.plans.bundle import ModelBundle


def native_importance(bundle: ModelBundle, spark) -> DataFrame:
    """Importances the model itself has; empty for models without any."""
    found = bundle.model.importance() or []
    rows = list(zip(bundle.feature_names, found))
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(F.col("Importance").desc(), "Feature")


def top_features(importance: DataFrame, top_n: int = 20) -> DataFrame:
    value = importance.columns[1]
    return importance.orderBy(F.col(value).desc(), "Feature").limit(top_n)


def attribution(bundle: ModelBundle, descriptors: DataFrame, id_col: str) -> DataFrame:
    """Mean absolute contribution of every feature over the whole table.

    Linear models: the exact contribution, coefficient times distance from the mean. Other models:
    the mean change of the output when the feature's value is taken from another row.
    """
    missing = [c for c in bundle.descriptor_columns if c not in descriptors.columns]
    if missing:
        raise ValueError("The descriptor table does not match the model.")
    rows = bundle.features(descriptors, [id_col])
    weights = bundle.model.weights()
    table = _linear(bundle, rows, weights) if weights is not None else _permuted(bundle, rows, id_col)
    return table.orderBy(F.col("MeanAbsAttribution").desc(), "Feature")


def _linear(bundle: ModelBundle, rows: DataFrame, weights: list[float]) -> DataFrame:
    scale = bundle.target_scale if bundle.is_regression else 1.0
    chosen = bundle.model.selected or list(range(len(weights)))
    mean = rows.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    values = rows.select(vector_to_array("features").alias("v"))
    sums = values.agg(
        *[F.avg(F.abs((F.get("v", F.lit(j)) - F.lit(float(mean[j]))) * F.lit(w * scale))).alias(f"a{i}") for i, (j, w) in enumerate(zip(chosen, weights))]
    )
    named = [F.struct(F.lit(n).alias("Feature"), F.col(f"a{i}").alias("MeanAbsAttribution")) for i, n in enumerate(bundle.feature_names)]
    return sums.select(F.explode(F.array(*named)).alias("r")).select("r.*")


def _outcome(bundle: ModelBundle, scored: DataFrame) -> Column:
    if bundle.is_regression:
        return F.col("prediction") * F.lit(bundle.target_scale)
    return F.get("probability", F.lit(1)) if len(bundle.labels) == 2 else F.array_max("probability")


def _permuted(bundle: ModelBundle, rows: DataFrame, id_col: str) -> DataFrame:
    """Each feature is shifted along a shuffled row order by its own distance.

    The shuffle carries one number per row and feature; donors meet their row again by its place in
    the order, a unique key.
    """
    names = bundle.preprocessor.output_names
    plain = rows.select(F.col(id_col).alias("id"), vector_to_array("features").alias("v"))
    numbered = materialize(with_row_number(plain, hash_order("id", "donor"), "__r"), "numbered")
    n = numbered.count()
    shift = F.lit(1) + F.pmod(F.col("j") * 7919, F.lit(max(n - 1, 1)))
    given = numbered.select("__r", F.posexplode("v").alias("j", "x"))
    donors = given.select((F.pmod(F.col("__r") - 1 + shift, F.lit(n)) + 1).alias("__to"), "j", "x")
    donors = donors.groupBy("__to").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("d"))  # one entry per feature
    joined = numbered.join(donors, F.col("__r") == F.col("__to"))
    base = bundle.model.predict(joined.select((F.col("__r") * len(names)).alias("key"), "__r", "v", "d", array_to_vector("v").alias("features")), "key")
    carried = base.select("__r", "v", "d", _outcome(bundle, base).alias("before"))  # the row's own output goes along with its variants
    variants = carried.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j"))
    changed = F.transform("v", lambda x, i: F.when(i == F.col("j"), F.get("d", F.col("j"))["x"]).otherwise(x))
    key = (F.col("__r") * len(names) + F.col("j")).alias("key")
    after = bundle.model.predict(variants.select(key, "j", "before", array_to_vector(changed).alias("features")), "key")
    moved = after.select("j", "before", _outcome(bundle, after).alias("after"))
    label = F.get(F.array(*[F.lit(name) for name in names]), F.col("j"))
    return moved.groupBy(label.alias("Feature")).agg(F.avg(F.abs(F.col("after") - F.col("before"))).alias("MeanAbsAttribution"))
