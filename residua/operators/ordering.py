"""Row numbers and running totals over tables of any size.

A window without partitions, or with one hot partition, runs in a single task. Here the rows are
range-partitioned on (group, order) instead, numbered inside each range, and the numbers are shifted
by the sizes of the ranges before. Only the range sizes meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from residua.operators.storage import materialize

_RANGE, _PLACE = "__range", "__place"


def _ranged(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Range partitions in order. The ranges are found from a sample, which reads the input a second time, so it is stored."""
    return materialize(
        materialize(df, f"{name}-input").repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias(_RANGE), F.monotonically_increasing_id().alias(_PLACE)),
        name,
    )


def _attach(stored: DataFrame, blocks: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join on (range, group), treating a missing group value as a value."""
    renamed = blocks.select(
        F.col(_RANGE).alias("__block_range"),
        *[F.col(g).alias(f"__block_{g}") for g in group],
        *[c for c in blocks.columns if c != _RANGE and c not in group],
    )
    matches = stored[_RANGE] == renamed["__block_range"]
    for g in group:
        matches = matches & stored[g].eqNullSafe(renamed[f"__block_{g}"])
    return stored.join(renamed, matches)


def with_row_number(
    df: DataFrame, order: Sequence[Column], out: str, group: Sequence[str] = ()
) -> DataFrame:
    """Number rows 1..n in an order, within each group. The order should end in a unique key."""
    columns = df.columns
    stored = _ranged(df, [F.col(g) for g in group] + list(order), "ordered")
    blocks = stored.groupBy(_RANGE, *group).agg(F.min(_PLACE).alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        _RANGE, *group, "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    if not group:
        blocks = F.broadcast(blocks)  # one row per range partition
    number = (F.col(_PLACE) - F.col("__first") + F.col("__before") + 1).cast("bigint")
    return _attach(stored, blocks, group).select(
        *[F.col(f"`{c}`") for c in columns if c != out], number.alias(out)
    )


def with_running_total(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` over this row and all rows ordered before it."""
    columns = df.columns
    stored = _ranged(df, list(order), "running")
    totals = stored.groupBy(_RANGE).agg(F.sum(value).alias("__rows"))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(_RANGE, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(_RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    running = stored.withColumn("__inside", F.sum(value).over(inside))
    return _attach(running, F.broadcast(totals), ()).select(
        *[F.col(f"`{c}`") for c in columns], (F.col("__inside") + F.col("__before")).alias(out)
    )


def hash_order(id_col: str, *salt: object) -> list[Column]:
    """Reproducible shuffled order: by the md5 of key and salt, then by the key."""
    parts = [F.col(id_col).cast("string")]
    for s in salt:
        parts += [F.lit(":"), s.cast("string") if isinstance(s, Column) else F.lit(str(s))]
    return [F.md5(F.concat(*parts)), F.col(id_col)]
