"""Numbers for rows whose ids are null or repeat, so that operators keyed by a document's id see each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residua.operators.storage import materialize

NUMBER = "__number_of_row"


def ids_are_unique(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null and none repeats: one aggregate of the ids alone."""
    counts = df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return counts.where("n > 1 or id is null").isEmpty()


def _keys(id_col: str, text: str) -> list:
    value = F.col(text).cast("string")
    return [F.col(id_col).alias("__id"), F.xxhash64(value).alias("__h1"), F.xxhash64(F.lit("second"), value).alias("__h2")]


def text_numbers(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Stored `__id`, `__h1`, `__h2`, `__number_of_row` of each distinct (id, text); numbers follow the order of ids, null first."""
    order = [F.col("__id").asc_nulls_first(), F.col("__h1"), F.col("__h2")]
    distinct = df.select(*_keys(id_col, text)).distinct()
    return materialize(
        distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(NUMBER, F.monotonically_increasing_id()), "row-numbers"
    )


def with_numbers(df: DataFrame, numbers: DataFrame, id_col: str, text: str) -> DataFrame:
    """`df` with the number of each row's (id, text). The hashes of the text spread the rows of a hot id."""
    keyed = df.withColumns(dict(zip(("__id2", "__g1", "__g2"), _keys(id_col, text))))
    same = (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2")) & F.col("__id").eqNullSafe(F.col("__id2"))
    return keyed.join(numbers, same).select(*df.columns, NUMBER)
