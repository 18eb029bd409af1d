"""Exact quantiles of many columns at once, in two scans and bounded memory at any row count.

The built-in exact percentile keeps all distinct values of a column in one buffer. Here the first scan makes a mergeable
sketch of every column: sorted runs whose weights double when a full run keeps every second value. Each such step can
move a rank by no more than the run's weight, so a sketch knows how far its ranks may be off, and the sketches of all
tasks, added up by column, give for every wanted rank a bracket of two values that surely holds it. The second scan counts
what lies below each bracket and keeps, counted, what lies inside. The rank is then found among those few values.
A value that a third of the rows share is one counted value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residua.operators.columns import numbers
from residua.operators.storage import materialize

#: Values a run may hold before it is halved; the rank error is about log2(rows / RUN) / (2 * RUN) of the rows.
RUN = 2048
#: Values of a bracket that are read at once; more are narrowed by counts of equal parts first.
LEAF_VALUES, BINS = 2000, 1024


@dataclass
class ColumnQuantiles:
    count: int
    minimum: float | None = None
    maximum: float | None = None
    values: dict[float, float | None] = field(default_factory=dict)


class Sketch:
    """Runs of sorted values; run h holds values that stand for 2^h each."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []
        self.count, self.error = 0, 0
        self.low, self.high = math.inf, -math.inf

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.count += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self._put(0, np.sort(values))

    def merge(self, other: "Sketch") -> None:
        self.count, self.error = self.count + other.count, self.error + other.error
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for level, run in enumerate(other.runs):
            self._put(level, run)

    def _put(self, level: int, values: np.ndarray) -> None:
        while len(values):
            while len(self.runs) <= level:
                self.runs.append(np.zeros(0))
            run = np.concatenate([self.runs[level], values])
            if len(run) <= RUN:
                self.runs[level] = run
                return
            run.sort(kind="stable")
            spare = len(run) % 2  # an odd one out stays; pairs keep one of two, by turns the lower and the upper
            self.runs[level], pairs = run[:spare], run[spare:]
            self.error += 1 << level
            values, level = pairs[(self.error >> level) % 2::2], level + 1

    def bracket(self, rank: int) -> tuple[float, float]:
        """Two values between which the value of a rank (from 0) lies, both included."""
        values = np.concatenate([run for run in self.runs])
        weights = np.repeat(1 << np.arange(len(self.runs)), [len(run) for run in self.runs])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])  # about as many rows are no larger
        below, above = rank - self.error, rank + self.error
        at = np.searchsorted(upto, below, side="right") - 1
        low = self.low if below < 0 or at < 0 else float(values[at])
        at = np.searchsorted(upto, above + 1, side="left")
        high = self.high if at >= len(values) else float(values[at])
        return low, high


_PARTS = "place int, level int, run array<double>, n long, error long, low double, high double"


def _sketched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First scan: the runs of each task's sketches."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch() for _ in columns]
        for batch in batches:
            for one, column in zip(sketches, batch.columns):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                one.add(values[~np.isnan(values)])
        for place, one in enumerate(sketches):
            # counts and ends go with the first run
            found = [(place, level, run, one.count * (level == 0), one.error * (level == 0), one.low, one.high) for level, run in enumerate(one.runs)]
            if found:
                arrays = [pa.array(list(part), kind) for part, kind in zip(zip(*found), _ARROW)]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return numbers(df, columns).mapInArrow(sketch, _PARTS)


_ARROW = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_NAMES = [part.split()[0] for part in _PARTS.split(", ")]


def wanted_ranks(count: int, probabilities: Sequence[float]) -> list[int]:
    return sorted({f(p * (count - 1)) for p in probabilities for f in (math.floor, math.ceil)}) if count else []


def _brackets(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """`place`, `n`, `low`, `high` of each column, and a bracket [`from`, `to`] for each wanted `rank`."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, whole = None, Sketch()

        def done() -> pa.RecordBatch:
            ranks = wanted_ranks(whole.count, probabilities)
            ends = [whole.bracket(rank) for rank in ranks]
            n = len(ranks)
            arrays = [
                pa.array([place] * n, pa.int32()), pa.array([whole.count] * n, pa.int64()), pa.array([whole.low] * n), pa.array([whole.high] * n),
                pa.array(ranks, pa.int64()), pa.array([e[0] for e in ends], pa.float64()), pa.array([e[1] for e in ends], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["place", "n", "low", "high", "rank", "from", "to"])

        for batch in batches:
            for i, here in enumerate(batch.column(0).to_pylist()):
                if here != place:
                    if place is not None:
                        yield done()
                    place, whole = here, Sketch()
                part = Sketch()
                _, level, _, part.count, part.error, part.low, part.high = (c[i].as_py() if k != 2 else None for k, c in enumerate(batch.columns))
                part.runs = [np.zeros(0)] * level + [batch.column(2)[i].values.to_numpy()]
                whole.merge(part)
        if place is not None:
            yield done()

    runs = _sketched(df, columns).repartition("place").sortWithinPartitions("place")
    return runs.mapInArrow(merge, "place int, n long, low double, high double, rank long, from double, to double")


@dataclass
class _Slot:
    """An interval of one column's values and the ranks searched in it, counted from its lower end."""

    place: int
    low: float
    high: float
    ranks: list[int]  # in the whole column


def _inside(df: DataFrame, columns: Sequence[str], slots: list[_Slot]) -> DataFrame:
    """Second scan: counted values inside the slots, and, with a null value, how many lie below."""
    by_place: dict[int, list[int]] = {}
    for number, slot in enumerate(slots):
        by_place.setdefault(slot.place, []).append(number)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(slots), np.int64)
        for batch in batches:
            numbers_, values_, counts_ = [], [], []
            for place, mine in by_place.items():
                column = batch.column(place).drop_null().to_numpy(zero_copy_only=False)
                column = column[~np.isnan(column)]
                for number in mine:
                    slot = slots[number]
                    below[number] += np.count_nonzero(column < slot.low)
                    found, counts = np.unique(column[(column >= slot.low) & (column <= slot.high)], return_counts=True)
                    numbers_.append(np.full(len(found), number, np.int32))
                    values_.append(found)
                    counts_.append(counts)
            if numbers_:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(numbers_)), pa.array(np.concatenate(values_), pa.float64()), pa.array(np.concatenate(counts_), pa.int64())], ["slot", "v", "n"]
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(slots)), pa.int32()), pa.nulls(len(slots), pa.float64()), pa.array(below)], ["slot", "v", "n"]
        )

    found = numbers(df, columns).mapInArrow(collect, "slot int, v double, n long")
    return materialize(found.groupBy("slot", "v").agg(F.sum("n").alias("n")), "brackets")


def _narrowed(values: DataFrame, limits: dict[int, tuple[float, float]], below: dict[int, int], ranks: dict[int, list[int]]) -> None:
    """Move the limits of slots that hold too many values to the equal parts with the wanted ranks."""
    rows = [(slot, low, high) for slot, (low, high) in limits.items()]
    table = F.broadcast(values.sparkSession.createDataFrame(rows, "slot int, low double, high double"))
    part = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1)).cast("int").alias("part")
    grouped = values.join(table, "slot").where("v >= low and v <= high").select("slot", part, "v", "n").groupBy("slot", "part")
    bins = grouped.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    for slot in limits:
        start = below[slot]
        for row in sorted((r for r in bins if r["slot"] == slot), key=lambda r: r["part"]):
            if start <= ranks[slot][0] < start + row["n"]:
                limits[slot], below[slot] = (row["low"], row["high"]), start
                break
            start += row["n"]


def _found(values: DataFrame, slots: list[_Slot]) -> dict[tuple[int, int], float]:
    """(place, rank) -> value, from the stored values of the brackets."""
    sizes = values.groupBy("slot").agg(
        F.count("v").alias("kept"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"), F.min("v").alias("low"), F.max("v").alias("high")
    ).collect()
    kept = {r["slot"]: r["kept"] for r in sizes}
    below = {r["slot"]: r["below"] for r in sizes}
    ranks = {i: s.ranks for i, s in enumerate(slots)}
    limits = {r["slot"]: (r["low"], r["high"]) for r in sizes}
    wide = {i for i in limits if kept[i] > LEAF_VALUES}
    while wide:
        narrowed = {i: limits[i] for i in wide if limits[i][0] < limits[i][1]}
        if not narrowed:
            break
        _narrowed(values, narrowed, below, ranks)
        limits |= narrowed
        left = _of(values, narrowed).groupBy("slot").agg(F.count("v").alias("kept")).collect()
        wide = {r["slot"] for r in left if r["kept"] > LEAF_VALUES}
    read = _of(values, limits).orderBy("slot", "v").collect() if limits else []
    out, start = {}, dict(below)
    for row in read:
        slot = row["slot"]
        for rank in ranks[slot]:
            if start[slot] <= rank < start[slot] + row["n"]:
                out[slots[slot].place, rank] = row["v"]
        start[slot] += row["n"]
    return out


def _of(values: DataFrame, limits: dict[int, tuple[float, float]]) -> DataFrame:
    rows = [(slot, low, high) for slot, (low, high) in limits.items()]
    table = F.broadcast(values.sparkSession.createDataFrame(rows, "slot int, low double, high double"))
    return values.join(table, "slot").where("v >= low and v <= high").select("slot", "v", "n")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, ColumnQuantiles]:
    """Quantiles with linear interpolation; missing values do not count."""
    result = {c: ColumnQuantiles(0) for c in columns}
    found, slots = {}, []
    for row in _brackets(df, columns, probabilities).collect():  # one row per column and wanted rank
        result[columns[row["place"]]] = ColumnQuantiles(row["n"], row["low"], row["high"])
        if row["from"] == row["to"]:
            found[row["place"], row["rank"]] = row["from"]
        else:
            slots.append(_Slot(row["place"], row["from"], row["to"], [row["rank"]]))
    if slots:
        found |= _found(_inside(df, columns, slots), slots)
    for place, c in enumerate(columns):
        column = result[c]
        for p in probabilities:
            if not column.count:
                column.values[p] = None
                continue
            at = p * (column.count - 1)
            low, high = found[place, math.floor(at)], found[place, math.ceil(at)]
            column.values[p] = low + (high - low) * (at - math.floor(at))
    return result
