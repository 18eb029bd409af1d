"""Sums of arrays by key, when each row holds a long array of numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sum_arrays(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """`keys` (whole numbers, not null) and the element-wise sum of their arrays; a task holds one sum at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(0)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in held), pa.array([total], pa.list_(pa.float64()))], [*keys, value])

        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))))
            for place, values in zip(places, batch.column(len(keys))):
                if place != held:
                    if held is not None:
                        yield done()
                    held, total = place, values.values.to_numpy().copy()
                else:
                    total += values.values.to_numpy()
        if held is not None:
            yield done()

    rows = df.select(*[df[k].cast("bigint").alias(k) for k in keys], value).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(add, ", ".join(f"{k} long" for k in keys) + f", {value} array<double>")
