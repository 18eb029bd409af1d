"""Stored intermediate tables: the place where lineage is cut, and the owner that drops them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[str, SparkSession] = {}
_OPEN = threading.local()
#: Has Spark delete the shuffle files of a query when it ends; without it they stay until the driver's heap is cleaned.
_CLEAN, _LOCK, _BLOCKS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock(), {}


def scratch_directory(spark: SparkSession) -> str:
    """Folder shared by all executors: `spark.checkpoint.dir`, or the session's checkpoint folder."""
    chosen = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not chosen:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    return chosen


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that start meanwhile are deleted at their end; the last of all blocks puts the setting back."""
    with _LOCK:
        running, before = _BLOCKS.get(spark, (0, None))
        if not running:
            before = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _BLOCKS[spark] = running + 1, before
    try:
        yield
    finally:
        with _LOCK:
            running, before = _BLOCKS.pop(spark)
            if running > 1:
                _BLOCKS[spark] = running - 1, before
            elif before is None:
                spark.conf.unset(_CLEAN)
            else:
                spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str = "table", keep: int = 0, **options: str) -> DataFrame:
    """Write a table once and go on from the stored rows.

    Later stages then neither repeat the work nor depend on executors that held shuffle files, and
    partition-dependent values (row positions) stay what they were when written. The table stays until
    the innermost `temporary` around it ends, or the one that is `keep` blocks further out; without any,
    until `drop_stored` is called, since results that are not yet computed may still read it.
    """
    spark = df.sparkSession
    path = f"{scratch_directory(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    around = getattr(_OPEN, "tables", [])
    if len(around) > keep:
        around[-1 - keep].append(path)
    _STORED[path] = spark
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside are deleted at the end, but for those to `keep`; shuffle files go as soon as their query ends.

    Nothing that is computed later may read those tables.
    """
    _OPEN.tables = [*getattr(_OPEN, "tables", []), []]
    try:
        with _shuffles_dropped(spark):
            yield
    finally:
        paths = _OPEN.tables[-1]
        _OPEN.tables = _OPEN.tables[:-1]
        _drop(spark, paths)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores by their key: a small file, or one of few row groups, is read by few tasks, and all that follows would stay there."""
    return df.repartition(3 * max(df.sparkSession.sparkContext.defaultParallelism, 1), *keys)


def stored_tables(spark: SparkSession) -> list[str]:
    """Where the tables stored so far are."""
    return [path for path, owner in _STORED.items() if owner is spark]


def drop_stored(spark: SparkSession, keep: Iterable[str] = ()) -> int:
    """Delete the tables stored so far but for `keep`, once their results have been written; returns how many."""
    return _drop(spark, [path for path in stored_tables(spark) if path not in set(keep)])


def _drop(spark: SparkSession, paths: list[str]) -> int:
    """Delete those of the tables that are still stored."""
    paths = [path for path in paths if path in _STORED]
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        del _STORED[path]
    return len(paths)
