"""Product codes of vectors, learned by k-means rounds whose searches are cut short by adaptive bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook. For every part of every row
a round keeps the b closest entries of the codebook in order: an upper bound of the distance to the first, a lower
bound for each other listed entry, and one outer bound below the distance to all entries that are not listed. After the
entries moved, bounds are loosened by the moves (upper ones rounded up, lower ones down, so they hold exactly).
A part whose upper bound stays below its second bound keeps its entry unseen. For the others the integer distance
to the entry at hand is compared with the bounds: only the listed entries that could be nearer are measured, and only if
the outer bound rules nothing out is the whole codebook searched. b is set anew each round from the number of
entries that such parts needed. All decisions rest on integer distances, so the codes equal plain assignment.

Each round is one scan that writes the rows with their bounds and one partial sum per task and entry to the
shared folder; Spark adds the partial sums. Only codebooks and sums of them (entries times components) meet on the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. Shorter vectors, empty
ones too, count as filled with zeros to the longest length, rounded up to a multiple of the number of parts. Rows that repeat an
id count as rows of their own; ids that tie for the first codebook go by their components, null ids come last. With fewer rows
than entries the codebook has as many entries as rows. Integer components beyond 2^28 / sqrt(part length) are set to that. An
empty table gives no rows. The error of a label is null where it passes 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residua.operators.storage import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bounds on b, and the share of searched parts that a listing should serve.
LEAST_LISTED, MOST_LISTED, SERVED = 2, 8, 0.9
FAR = 2**31 - 1
FEW_LABELS = 100_000
_ROW, _SUM, _DEPTH = 0, 1, 2


def floor_root(squares: np.ndarray) -> np.ndarray:
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    return roots + ((roots + 1) * (roots + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    roots = floor_root(squares)
    return roots + (roots * roots < squares)


def squares_to(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of (n, m) rows to (n, c, m) or (c, m) entries."""
    difference = rows[:, None, :] - entries
    return np.einsum("ncm,ncm->nc", difference, difference)


def _ordered(squares: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Places of the entries from the nearest on, ties by lower index."""
    return np.lexsort((np.broadcast_to(entries, squares.shape), squares), axis=1)


@dataclass
class Listing:
    """The listed entries of each row, -1 where none, and their bounds: upper, lower ones, outer."""

    near: np.ndarray  # (n, b)
    bounds: np.ndarray  # (n, b + 1)

    @staticmethod
    def empty(rows: int, listed: int) -> "Listing":
        return Listing(np.full((rows, listed), -1, np.int64), np.full((rows, listed + 1), FAR, np.int64))

    def resized(self, listed: int) -> "Listing":
        """With room for another number of entries; the outer bound takes in the ones that leave."""
        now, new = self.near.shape[1], Listing.empty(len(self.near), listed)
        kept = min(now, listed)
        new.near[:, :kept], new.bounds[:, :kept] = self.near[:, :kept], self.bounds[:, :kept]
        new.bounds[:, kept:] = self.bounds[:, kept, None]
        return new

    def loosen(self, moved: np.ndarray) -> None:
        """Take the moves of the entries into the bounds, and let each lower bound hold for all entries after it."""
        most = moved.max(initial=0)
        self.bounds[:, 0] += moved[self.near[:, 0]]
        self.bounds[:, 1:-1] -= np.where(self.near[:, 1:] < 0, most, moved[self.near[:, 1:]])
        self.bounds[:, -1] -= most
        self.bounds[:, 1:] = np.maximum(np.minimum.accumulate(self.bounds[:, :0:-1], axis=1)[:, ::-1], 0)

    def search(self, rows: np.ndarray, book: np.ndarray) -> np.ndarray:
        """List every row's nearest entries anew from the whole codebook; returns the number of entries measured."""
        squares = squares_to(rows, book)
        order = _ordered(squares, np.arange(len(book)))
        roots = floor_root(np.take_along_axis(squares, order, 1))
        listed = min(self.near.shape[1], len(book))
        self.near[:, :listed] = order[:, :listed]
        self.bounds[:, 1:] = FAR
        self.bounds[:, 1:listed] = roots[:, 1:listed]
        if len(book) > listed:
            self.bounds[:, listed] = roots[:, listed]
        self.bounds[:, 0] = ceil_root(squares[np.arange(len(rows)), order[:, 0]])
        return np.full(len(rows), len(book))

    def update(self, rows: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Make the first listed entry the nearest one; returns how many entries each row measured."""
        depth = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.bounds[:, 0] >= self.bounds[:, 1])
        if not len(open_):
            return depth
        squares = squares_to(rows[open_], book[self.near[open_, :1]])[:, 0]
        self.bounds[open_, 0] = ceil_root(squares)
        ruled_out = squares[:, None] < self.bounds[open_, 1:] ** 2
        needed = np.where(ruled_out.any(axis=1), ruled_out.argmax(axis=1) + 1, len(book))
        depth[open_] = needed
        whole = ~ruled_out.any(axis=1)
        for count in np.unique(needed[~whole & (needed > 1)]):
            some = open_[~whole & (needed == count)]
            entries = self.near[some, :count]
            squares = squares_to(rows[some], book[entries])
            order = _ordered(squares, entries)
            squares = np.take_along_axis(squares, order, 1)
            self.near[some, :count] = np.take_along_axis(entries, order, 1)
            self.bounds[some, 1:count] = floor_root(squares[:, 1:])
            self.bounds[some, 0] = ceil_root(squares[:, 0])
        rest = open_[whole]
        if len(rest):
            found = Listing(self.near[rest], self.bounds[rest])
            found.search(rows[rest], book)
            self.near[rest], self.bounds[rest] = found.near, found.bounds
        return depth


def integer_parts(df: DataFrame, id_col: str, vector: str, label: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """Stored rows (vec_id, label, parts) of usable vectors as integers of one length, and that length."""
    doubles = F.col(vector).cast("array<double>")
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(usable, F.lit(False)))
    length = rows.agg(F.max(F.size(vector)).alias("longest")).first()["longest"] or 0
    length = max(1, -(-length // parts)) * parts
    most = int(2**28 / (length / parts) ** 0.5)
    within = lambda x: F.least(F.greatest(x, F.lit(-float(most))), F.lit(float(most)))
    clamped = F.transform(doubles, lambda x: F.floor(within(x * scale)).cast("int"))
    filled = F.concat(clamped, F.array_repeat(F.lit(0), F.lit(length) - F.size(vector)))
    out = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).alias("label"), filled.alias("parts"))
    return materialize(out, "parts"), length


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of each part moved at most, as integers: (parts, entries)."""
    difference = new - old
    return ceil_root((difference * difference).sum(axis=2))


def _fields(label: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("kind", pa.int32()), ("vec_id", pa.int64()), ("label", label), ("parts", pa.list_(pa.int32())), ("near", pa.list_(pa.int8())),
        ("bounds", pa.list_(pa.int32())), ("errors", pa.list_(pa.int64())), ("key", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
    ])


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of equal length per row."""
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def assign_round(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, listed: int, with_errors: bool = False) -> DataFrame:
    """One stored round: rows with their listings, and each task's sums and search depths.

    `books` is (parts, entries, part length); `moved` is None in the first round, when nothing is listed yet.
    """
    parts, entries, width = books.shape
    spark_label = rows.schema["label"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        depths = np.zeros(entries + 1, np.int64)
        schema = None
        for batch in source:
            n = batch.num_rows
            schema = schema or _fields(batch.schema.field("label").type)
            if not n:
                continue
            vectors = batch.column("parts").flatten().to_numpy().reshape(n, parts, width).astype(np.int64)
            if moved is not None:
                near = batch.column("near").flatten().to_numpy().reshape(n, parts, -1).astype(np.int64)
                bounds = batch.column("bounds").flatten().to_numpy().reshape(n, parts, -1).astype(np.int64)
            out_near, out_bounds = np.zeros((n, parts, listed), np.int8), np.zeros((n, parts, listed + 1), np.int32)
            errors = np.zeros((n, parts), np.int64)
            for p in range(parts):
                part = np.ascontiguousarray(vectors[:, p])
                if moved is None:
                    state = Listing.empty(n, listed)
                    depth = state.search(part, books[p])
                else:
                    state = Listing(near[:, p].copy(), bounds[:, p].copy())
                    state.loosen(moved[p])
                    state = state.resized(listed)
                    depth = state.update(part, books[p])
                depths += np.bincount(depth, minlength=entries + 1)
                chosen = state.near[:, 0]
                sums[p] += (chosen == np.arange(entries)[:, None]).astype(np.int64) @ part
                counts[p] += np.bincount(chosen, minlength=entries)
                out_near[:, p], out_bounds[:, p] = state.near, np.clip(state.bounds, 0, FAR)
                if with_errors:
                    errors[:, p] = squares_to(part, books[p][chosen][:, None, :])[:, 0]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, _ROW, np.int32)), batch.column("vec_id"), batch.column("label"), batch.column("parts"),
                _lists(out_near.reshape(n, -1), pa.int8()), _lists(out_bounds.reshape(n, -1), pa.int32()),
                _lists(errors, pa.int64()) if with_errors else pa.nulls(n, pa.list_(pa.int64())),
                none.cast(pa.int32()), none, pa.nulls(n, pa.list_(pa.int64())),
            ], schema=schema)
        if schema is not None and counts.any():
            used = np.flatnonzero(counts.ravel())
            met = np.flatnonzero(depths)
            yield pa.RecordBatch.from_pylist(
                [{"kind": _SUM, "key": int(k), "n": int(counts.ravel()[k]), "sums": sums.reshape(-1, width)[k].tolist()} for k in used]
                + [{"kind": _DEPTH, "key": int(k), "n": int(depths[k])} for k in met], schema=schema,
            )

    out = (
        f"kind int, vec_id long, label {spark_label}, parts array<int>, near array<tinyint>, bounds array<int>, errors array<long>, "
        "key int, n long, sums array<long>"
    )
    return materialize(rows.mapInArrow(batches, out), "listings")


def gathered(stored: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks, and how many parts measured how many entries; Spark adds the tasks' partial sums."""
    parts, entries, width = books.shape
    partial = stored.where(F.col("kind") != _ROW)
    totals = partial.groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    sums = partial.where(F.col("kind") == _SUM).select("key", F.posexplode("sums").alias("place", "value"))
    sums = sums.groupBy("key", "place").agg(F.sum("value").alias("value")).collect()  # at most entries times components
    new, depths = books.copy().reshape(parts * entries, width), np.zeros(entries + 1, np.int64)
    counts = np.zeros(parts * entries, np.int64)
    for row in totals:
        (counts if row.kind == _SUM else depths)[row.key] = row.n
    for row in sums:
        new[row.key, row.place] = row.value // int(counts[row.key])
    return new.reshape(books.shape), depths


def next_listed(depths: np.ndarray, listed: int) -> int:
    """b for the next round: the fewest entries that would have served `SERVED` of the parts that were searched."""
    entries = len(depths) - 1
    searched = depths[2:].sum()
    if not searched:
        return max(LEAST_LISTED, listed - 1)
    if depths[listed + 1:].sum() > (1 - SERVED) * searched:
        return min(listed + 1, MOST_LISTED, entries) if entries >= LEAST_LISTED else listed
    served = np.cumsum(depths[2:]) >= SERVED * searched
    return max(LEAST_LISTED, min(listed, int(served.argmax()) + 2))


@dataclass
class Codes:
    rows: DataFrame  # vec_id, label, codes array<tinyint>, errors array<long>
    codebooks: np.ndarray
    listed: list[int]  # b of each round
    depths: list[np.ndarray]  # parts by entries measured, of each round


def compress(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """Learn a codebook per part and code every row."""
    rows, length = integer_parts(df, id_col, vector, label, scale, parts)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    shape = (len(seeds), parts, length // parts)
    books = np.array([r.parts for r in seeds], np.int64).reshape(shape).transpose(1, 0, 2).copy()
    listed, moved, used, all_depths = max(LEAST_LISTED, entries // 4), None, [], []
    if seeds:
        for n in range(rounds + 1):
            rows = assign_round(rows, books, moved, listed, with_errors=n == rounds)
            new, depths = gathered(rows, books)
            rows = rows.where(F.col("kind") == _ROW)
            used.append(listed)
            all_depths.append(depths)
            if n < rounds:
                moved, books = moves(books, new), new
                listed = next_listed(depths, listed) if n else listed  # the first round searches everything
        codes = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get("near", p * (F.size("near") / parts).cast("int")))
        rows = rows.select("vec_id", "label", codes.alias("codes"), "errors")
    else:
        rows = rows.select("vec_id", "label", F.lit(None).cast("array<tinyint>").alias("codes"), F.lit(None).cast("array<long>").alias("errors"))
    return Codes(rows, books, used, all_depths)


def code_report(codes: Codes) -> DataFrame:
    """`vec_id`, `code`, `error`, `label_error`, `codebooks_sha256` of every coded row."""
    digest = hashlib.sha256(",".join(map(str, codes.codebooks.ravel().tolist())).encode()).hexdigest()
    hexadecimal = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    rows = codes.rows.select(
        "vec_id", "label", hexadecimal.alias("code"), F.aggregate("errors", F.lit(0).cast("long"), lambda total, e: total + e).alias("error")
    )
    sums = materialize(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "__label")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)  # at most FEW_LABELS rows of a label and a number; beyond it Spark splits the hot labels
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
