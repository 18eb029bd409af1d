"""Many columns as (place, value) rows.

Statistics of a wide table as one aggregate per column make code too large to compile well. As rows
grouped by column number they are one small hash aggregation, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions.sequences import to_number


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as numbers, null where a value does not parse."""
    types = dict(df.dtypes)
    return df.select(*[to_number(F.col(f"`{c}`"), types[c]).alias(c) for c in columns])


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per present value: `place` of its column in the list, `v`."""
    types = dict(df.dtypes)
    values = F.array(*[
        to_number(F.col(f"`{c}`"), types[c]) if types[c] == "string" else F.col(f"`{c}`").cast("double") for c in columns
    ])
    rows = df.select(F.posexplode(values).alias("place", "v"))
    return rows.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present, null where one does not vary.

    The built-in aggregate fails on a constant column when division by zero is an error.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
