"""Semi join that keeps a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 10_000  # a key is hot from 1/10,000 of all rows, so at most 10,000 keys are hot
SALTS = 256


def semi_join_by_key(df: DataFrame, key: str, counted: DataFrame, rows: str) -> DataFrame:
    """Rows of `df` whose key occurs in `counted` (one row per key with its number of rows).

    The rows of a hot key are dealt to many salted copies of the key; the hot keys themselves are
    few, as bounded by their share, and are broadcast to find those rows.
    """
    total = counted.agg(F.sum(rows)).scalar()
    keys = counted.select(F.col(key).alias("__key"), (F.col(rows) * HOT_SHARE >= total).alias("__is_hot"))
    hot = F.broadcast(keys.filter("__is_hot").select(F.col("__key").alias("__hot")))
    last = F.when(F.col("__is_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0))
    salted_keys = keys.select("__key", F.explode(F.sequence(F.lit(0), last)).alias("__key_salt"))
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = df.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    matches = (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__key_salt"))
    return salted.join(salted_keys, matches, "left_semi").drop("__salt")
