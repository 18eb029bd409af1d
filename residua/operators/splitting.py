"""Reproducible splits and cross-validation folds, exact in size per stratum."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions.naming import is_classification
from residua.operators.ordering import hash_order, with_row_number
from residua.operators.quantiles import exact_quantiles
from residua.operators.storage import materialize

REPEATS = 5
BROADCAST_STRATA = 100_000


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.2
    val_size: float = 0.1
    random_state: int = 42


def regression_bins(df: DataFrame, target: str, max_bins: int = 5) -> Column | None:
    """Expression for the target's quantile bin, or nothing where bins would be too thin."""
    value = F.col(target)
    rows = df.filter(value.isNotNull()).count()
    if rows < 12 or df.filter(value.isNotNull()).select(target).distinct().limit(4).count() < 4:
        return None
    bins = min(max_bins, max(2, int(math.sqrt(rows))))
    found = exact_quantiles(df, [target], [i / bins for i in range(bins + 1)])[target].values
    edges = sorted(set(found.values()))
    place = F.lit(None).cast("int")
    for i in reversed(range(1, len(edges))):
        place = F.when(value <= F.lit(edges[i]), F.lit(i - 1)).otherwise(place)
    binned = df.filter(value.isNotNull()).groupBy(place.alias("b")).agg(F.count("*").alias("n"))
    sizes = [r["n"] for r in binned.collect()]
    return place if len(sizes) >= 2 and min(sizes) >= 2 else None


def allocate(sizes: dict, total: int) -> dict:
    """Share a total over strata in proportion; left-over rows go to the largest remainders."""
    rows = sum(sizes.values())
    share = {s: n * total // rows for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(sizes[s] * total % rows), s))
    for s in order[: total - sum(share.values())]:
        share[s] += 1
    return share


def with_split(df: DataFrame, id_col: str, target: str, task: str, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Add `split` (train, val, test), stratified by class or by target bin.

    Rows are put in md5 order inside their stratum and cut at exact counts. The strata of the validation
    cut are made anew from the rows that the test cut left. Where the target is too small or too even for
    strata, the cut is made without them; `is_stratified` tells.
    """
    cut = _with_cut(df, id_col, target, task, config.test_size, config.random_state)
    test, rest = cut.filter("__in").drop("__in").withColumn("split", F.lit("test")), cut.filter("not __in").drop("__in")
    if config.val_size <= 0:
        return test.unionByName(rest.withColumn("split", F.lit("train")))
    relative = min(max(config.val_size / (1.0 - config.test_size), 0.05), 0.5)
    second = _with_cut(materialize(rest, "rest"), id_col, target, task, relative, config.random_state)
    return test.unionByName(second.withColumn("split", F.when(F.col("__in"), "val").otherwise("train")).drop("__in"))


def is_stratified(df: DataFrame, target: str, task: str) -> bool:
    """Whether a split of these rows has strata: always by class, by target bin only with enough rows and values."""
    return is_classification(task) or regression_bins(df, target) is not None


def _with_cut(df: DataFrame, id_col: str, target: str, task: str, share: float, seed: int) -> DataFrame:
    """Add `__in`: whether a row belongs to the first `share` of its stratum."""
    stratum = F.col(target).cast("string") if is_classification(task) else regression_bins(df, target)
    tagged = df.withColumn("__stratum", F.coalesce(stratum.cast("string"), F.lit("")) if stratum is not None else F.lit(""))
    sizes = {r["__stratum"]: r["n"] for r in tagged.groupBy("__stratum").agg(F.count("*").alias("n")).collect()}
    taken = allocate(sizes, math.ceil(share * sum(sizes.values()))) if sizes else {}
    cuts = df.sparkSession.createDataFrame(list(taken.items()), "__s string, __cut bigint")
    numbered = with_row_number(tagged, hash_order(id_col, seed), "__n", ["__stratum"])
    small = F.broadcast(cuts) if len(taken) <= BROADCAST_STRATA else cuts
    joined = numbered.join(small, F.col("__stratum") == F.col("__s"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__n") <= F.col("__cut")).alias("__in"))


def fold_count(task: str, requested: int, rows: int, smallest_class: int | None = None) -> int | None:
    """Folds that the data allows; nothing when a class has fewer than two rows."""
    folds = max(2, int(requested))
    folds = min(folds, smallest_class or 0) if is_classification(task) else min(folds, max(2, rows // 2))
    return folds if folds >= 2 else None


def cv_folds(df: DataFrame, id_col: str, folds: int, label: str | None = None, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(id, repeat, fold): every repeat deals the rows, in its own md5 order, to equal folds.

    With a label each class is dealt on its own.
    """
    columns = [F.col(id_col)] + ([F.col(label).alias("__label")] if label else [])
    spread = df.select(*columns, F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    group = ["repeat"] + (["__label"] if label else [])
    numbered = with_row_number(spread, hash_order(id_col, F.col("repeat"), seed), "__n", group)
    return numbered.select(id_col, "repeat", ((F.col("__n") - 1) % folds).cast("int").alias("fold"))


def sample_rows(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """A reproducible sample: the first rows in md5 order, kept per task before the merge."""
    return df.orderBy(*hash_order(id_col)).limit(rows)
