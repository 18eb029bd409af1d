"""Pairwise-complete second moments of many columns in one scan.

Each task keeps, for every ordered pair of columns, the number of rows where both are present and the sums over
those rows of x, x² and xy, as matrix products of values and presence masks. Values are taken relative to the task's
first value of each column, so large offsets cost no digits. Tasks hand over one row per column; these rows are
added up by column, each brought to the first one's offsets, so what one task holds is one or a few rows of
the matrices, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from residua.operators.columns import numbers

#: Variance below this share of the mean square about the offset is rounding: the column does not vary.
FLAT = 1e-13
_PARTS = ("n", "x", "xx", "xy", "y", "yy", "offset")
_ROW = "place int, " + ", ".join(f"{name} array<double>" for name in _PARTS)


class Moments:
    """Sums of one task, as (columns, columns) matrices over the rows where both columns are present."""

    def __init__(self, columns: int) -> None:
        self.offset = np.full(columns, np.nan)
        self.n, self.x, self.xx, self.xy = (np.zeros((columns, columns)) for _ in range(4))

    def add(self, values: np.ndarray) -> None:
        """Rows of values, not a number where missing."""
        present = np.isfinite(values)
        unset = np.isnan(self.offset) & present.any(axis=0)
        self.offset[unset] = values[present.argmax(axis=0), np.arange(values.shape[1])][unset]
        known = np.where(present, values - np.where(np.isnan(self.offset), 0.0, self.offset), 0.0)
        self.xy += known.T @ known
        if present.all():
            self.n += len(values)
            self.x += known.sum(axis=0)[:, None]
            self.xx += (known * known).sum(axis=0)[:, None]
        else:
            mask = present.astype(np.float64)
            self.n += mask.T @ mask
            self.x += known.T @ mask
            self.xx += (known * known).T @ mask

    def rows(self) -> pa.RecordBatch:
        offset = np.where(np.isnan(self.offset), 0.0, self.offset)
        parts = [self.n, self.x, self.xx, self.xy, self.x.T, self.xx.T, np.broadcast_to(offset, self.n.shape)]
        lists = [pa.array(list(np.ascontiguousarray(p)), pa.list_(pa.float64())) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(self.n)), pa.int32()), *lists], ["place", *_PARTS])


def rebased(sums: dict[str, np.ndarray], place: int, offset: np.ndarray) -> dict[str, np.ndarray]:
    """One column's sums, taken relative to other offsets."""
    d, e = sums["offset"][place] - offset[place], sums["offset"] - offset
    n, x, y = sums["n"], sums["x"], sums["y"]
    return {
        "n": n, "x": x + d * n, "xx": sums["xx"] + 2 * d * x + d * d * n, "y": y + e * n, "yy": sums["yy"] + 2 * e * y + e * e * n,
        "xy": sums["xy"] + d * y + e * x + d * e * n, "offset": offset,
    }


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Correlations of each column with all others, from rows that are sorted by column."""
    place, total = None, {}

    def done() -> pa.RecordBatch:
        found = _correlations(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int32()), pa.array([list(total["n"])], pa.list_(pa.float64())), pa.array([found], pa.list_(pa.float64()))], ["place", "n", "corr"]
        )

    for batch in batches:
        for i, here in enumerate(batch.column(0).to_pylist()):
            sums = {name: batch.column(c + 1)[i].values.to_numpy() for c, name in enumerate(_PARTS)}
            if here != place:
                if place is not None:
                    yield done()
                place, total = here, sums
            else:
                moved = rebased(sums, place, total["offset"])
                total = {k: v if k == "offset" else total[k] + v for k, v in moved.items()}
    if place is not None:
        yield done()


def _correlations(sums: dict[str, np.ndarray]) -> list[float | None]:
    n = np.maximum(sums["n"], 1)
    x, y = sums["xx"] - sums["x"] ** 2 / n, sums["yy"] - sums["y"] ** 2 / n
    flat = (sums["n"] < 2) | (x <= FLAT * sums["xx"]) | (y <= FLAT * sums["yy"])
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (sums["xy"] - sums["x"] * sums["y"] / n) / np.sqrt(x * y)
    return [None if f or not np.isfinite(r) else float(min(1.0, max(-1.0, r))) for f, r in zip(flat, found)]


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`place` of each column, `n` and `corr`: with every column, the rows where both are present and their Pearson correlation.

    Null where either does not vary over those rows. Infinite values count as missing. A table without rows gives no rows.
    """
    width = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, met = Moments(width), False
        for batch in batches:
            if batch.num_rows:
                moments.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]))
                met = True
        if met:
            yield moments.rows()

    partial = numbers(df, columns).mapInArrow(sums, _ROW)
    return partial.repartition("place").sortWithinPartitions("place").mapInArrow(_added, "place int, n array<double>, corr array<double>")
