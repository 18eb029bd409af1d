"""Exact k-nearest-neighbour join.

A small reference table (bytes and rows checked: every query is held against every row of it) is broadcast. A larger one is cut into cells around pivots
and each query first visits the nearest, which bounds the distance of its k-th neighbour, then only
the cells that the triangle inequality cannot rule out within that bound. Cells are cut into blocks of bounded size and a block that many
queries visit is copied to several groups, so no group grows with the data. Where the columns do not separate the rows (many columns),
queries visit most blocks: then every query is held against every row. The reference rows are stored once, packed into pages, and every task reads
them page by page past its part of the queries, keeping the k nearest rows so far: nothing but the queries is shuffled. How many blocks
queries would visit is told from a sample of them; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from residua.operators.storage import materialize, temporary

BROADCAST_BYTES = 64 * 2**20
BLOCK_ROWS, GROUP_QUERIES = 20_000, 50_000
#: Rows that a query is held against where the reference table is broadcast.
BROADCAST_ROWS = 50_000
MAX_PIVOTS = 1024
#: Up to this many columns cells separate the rows well: with about as many cells as rows in a few cells, a query costs the root of the rows.
FEW_COLUMNS, MAX_SMALL_PIVOTS = 4, 8192
#: Blocks a query may visit on average, and the share of all, beyond which every query is held against every row; block counts that may be broadcast.
MOST_VISITS, MOST_SHARE, BROADCAST_BLOCKS = 64, 0.25, 400_000
#: Queries whose neighbours are looked up to tell how many blocks all would visit.
SAMPLED = 500
#: Rows and bytes of a stored page and bytes of a row group of pages; queries, and bytes of them, that a task holds; rows it holds them against at
#: once, which are a part of all; parts that are stored as pages and gone through in one round.
PAGE_ROWS, PAGE_BYTES, GROUP_BYTES, PART_QUERIES, PART_ROWS, PART_BYTES, PARTS_AT_ONCE = 1000, 64 * 2**10, 8 * 2**20, 40_000, 40_000, 16 * 2**20, 32
#: Queries and rows whose distances are held at once, and candidates whose distances are taken again at once.
_TILE_QUERIES, _TILE_ROWS, _AGAIN = 256, 4096, 50_000
_FOUND = "query_id bigint, train_id bigint, distance double, y double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _distances(queries: np.ndarray, train: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    parts = [np.zeros(0)]
    for at in range(0, len(row), _AGAIN):
        difference = queries[row[at:at + _AGAIN]] - train[col[at:at + _AGAIN]]
        parts.append(np.sqrt((difference * difference).sum(1)))
    return np.concatenate(parts)


class _Nearest:
    """The k nearest of the reference rows met so far per query, those beyond `within` left out; equal distances go to the lower id."""

    def __init__(self, queries: np.ndarray, k: int, within: np.ndarray | None = None) -> None:
        self.queries, self.k = queries, k
        self.bound = np.full(len(queries), np.inf) if within is None else within.astype(np.float64)
        self.row, self.ids, self.far, self.ys = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def meet(self, train_ids: np.ndarray, train: np.ndarray, ys: np.ndarray) -> None:
        """Candidates come from matrix products in single precision, widened by what their rounding can come to; their distances are then taken
        again by difference, so order and ties are exact. Every tile of rows tightens the bound for the next.
        """
        if not len(self.queries) or not len(train):
            return
        queries, k = self.queries, self.k
        centre = train.mean(0)
        centre = np.where(np.isfinite(centre), centre, 0.0)
        near_queries, near_train = queries - centre, train - centre
        a, b = (near_queries * near_queries).sum(1), (near_train * near_train).sum(1)
        size = max((x[np.isfinite(x)].max(initial=0.0) for x in (a, b))) or 1.0
        a, b, root = a / size, b / size, size**0.5
        # A product of rounded vectors strays by less than half of `error` times (a + 2 b), a sum of squares being over twice the product.
        error = (train.shape[1] + 8) * 2.0**-23
        left = np.column_stack([near_queries * (-2.0 / root), np.ones(len(queries))]).astype(np.float32)
        right = np.column_stack([near_train / root, b * (1 - 2 * error)]).astype(np.float32)
        before = np.searchsorted(self.row, np.arange(0, len(queries) + _TILE_QUERIES, _TILE_QUERIES))
        parts = []
        for tile, first in enumerate(range(0, len(queries), _TILE_QUERIES)):
            part, known = slice(first, first + _TILE_QUERIES), slice(before[tile], before[tile + 1])
            bound = self.bound[part]  # a view: what is found here holds for the rows of later calls
            row, ids, far, y = self.row[known] - first, self.ids[known], self.far[known], self.ys[known]
            for start in range(0, len(train), _TILE_ROWS):
                rough = left[part] @ right[start:start + _TILE_ROWS].T
                square = bound * bound / size
                if start == 0 and rough.shape[1] >= k and not np.isfinite(bound).all():
                    kth = np.partition(rough, k - 1, axis=1)[:, k - 1] + a[part] * (1 + error) + 3 * error * b[:_TILE_ROWS].max()
                    square = np.fmin(square, kth * (1 + 1e-6))
                limit = (square * (1 + error) - a[part] * (1 - error) + 1e-30).astype(np.float32)
                r, c = np.divmod(np.flatnonzero(rough <= limit[:, None]), rough.shape[1])
                if not len(r):
                    continue
                c += start
                d = _distances(queries[part], train, r, c)
                row, ids, far, y = (np.concatenate(pair) for pair in ((row, r), (ids, train_ids[c]), (far, d), (y, ys[c])))
                order = np.lexsort((ids, far, row))
                row, ids, far, y = row[order], ids[order], far[order], y[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = (place < k) & (far <= bound[row])
                bound[row[place == k - 1]] = np.minimum(bound[row[place == k - 1]], far[place == k - 1])
                row, ids, far, y = row[kept], ids[kept], far[kept], y[kept]
            parts.append((row + first, ids, far, y))
        self.row, self.ids, self.far, self.ys = map(np.concatenate, zip(*parts))

    def found(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        return {"query_id": ids[self.row], "train_id": self.ids, "distance": self.far, "y": self.ys}


def _nearest(
    ids: np.ndarray, queries: np.ndarray, train_ids: np.ndarray, train: np.ndarray, ys: np.ndarray, k: int, within: np.ndarray | None = None
) -> pd.DataFrame:
    """k nearest reference rows per query, those beyond `within` left out."""
    nearest = _Nearest(queries, k, within)
    nearest.meet(train_ids, train, ys)
    return pd.DataFrame(nearest.found(ids))


def _k_per_vector(train: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """Of rows with the same vector only the k lowest ids can be neighbours: those rows, their number and width.

    Only vectors whose hash more than k rows have are moved.
    """
    hashed = train.withColumn("__hash", F.xxhash64("vector"))
    counted = hashed.groupBy("__hash").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"))
    rows, most, width = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("width"), F.lit(0))).first()
    if most <= k:
        return train, rows, width
    often = materialize(counted.filter(F.col("n") > k).select("__hash"), "often")
    same = Window.partitionBy("vector").orderBy("train_id")
    first = hashed.join(often, "__hash", "left_semi").withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k)
    seldom = hashed.join(often, "__hash", "left_anti")
    train = materialize(seldom.select(*train.columns).unionByName(first.select(*train.columns)), "reference")
    return train, train.count(), width


def nearest_neighbors(
    queries: DataFrame, train: DataFrame, query_id: str, train_id: str, features: Sequence[str] | str, y: str, k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query_id, train_id, distance, y) of the k nearest reference rows by Euclidean distance.

    `features` is a list of numeric columns or the name of one array column.
    """
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), _vector(features).alias("vector"))
    t = train.select(F.col(train_id).cast("bigint").alias("train_id"), _vector(features).alias("vector"), F.col(y).cast("double").alias("y"))
    with temporary(q.sparkSession):
        with temporary(q.sparkSession):
            t, rows, width = _k_per_vector(materialize(t, "reference"), k)
            if rows <= BROADCAST_ROWS and rows * (width + 2) * 8 <= broadcast_bytes:
                return _broadcast_search(q, t, k)
            placed, pivots = _placed(t, rows, width)
        return _cell_search(q, placed, pivots, k, rows, width)


def _vector(features: Sequence[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features)
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def _broadcast_search(q: DataFrame, t: DataFrame, k: int) -> DataFrame:
    table = t.toPandas()
    shared = q.sparkSession.sparkContext.broadcast(
        (table["train_id"].to_numpy(), _matrix(table["vector"]), table["y"].to_numpy())
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train_ids, vectors, ys = shared.value
        for batch in batches:
            if len(train_ids) and len(batch):
                yield _nearest(batch["query_id"].to_numpy(), _matrix(batch["vector"]), train_ids, vectors, ys, k)

    return q.mapInPandas(search, _FOUND)


def _placed(t: DataFrame, rows: int, width: int) -> tuple[DataFrame, np.ndarray]:
    """Reference rows with the nearest of some pivots, and the pivots."""
    wanted = min(MAX_PIVOTS, max(2, 4 * rows // BLOCK_ROWS))
    if width <= FEW_COLUMNS:
        wanted = max(wanted, min(MAX_SMALL_PIVOTS, int(2 * rows**0.5)))
    order = F.md5(F.col("train_id").cast("string"))
    pivots = _matrix(t.orderBy(order, "train_id").limit(wanted).select("vector").toPandas()["vector"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                distances = np.sqrt(_squares(_matrix(batch["vector"]), pivots))
                cell = distances.argmin(1)
                yield batch.assign(cell=cell, off=distances[np.arange(len(batch)), cell])

    return materialize(t.mapInPandas(assign, "train_id bigint, vector array<double>, y double, cell int, off double"), "cells", keep=1), pivots


def _cell_search(q: DataFrame, placed: DataFrame, pivots: np.ndarray, k: int, rows: int, width: int) -> DataFrame:
    """Two rounds: the nearest cell of a query bounds its k-th distance, then only cells within that bound are visited."""
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).toPandas()  # one row per pivot
    cells, radius, counts = stats["cell"].to_numpy(), stats["radius"].to_numpy(), stats["n"].to_numpy()
    blocks = np.ceil(counts / BLOCK_ROWS).astype(int)
    centres = pivots[cells]
    slack = 1e-6 * (1.0 + np.abs(pivots).max())
    most = min(MOST_VISITS, MOST_SHARE * int(blocks.sum()))
    if width > FEW_COLUMNS and _expected_visits(q, placed, centres, radius, slack, blocks, k) > most:
        return _all_pairs(q.withColumn("within", F.lit(float("inf"))), placed, k, rows, width)

    def visits(bounded: bool):
        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first in range(0, len(batch), 1000):
                    part = batch.iloc[first : first + 1000].reset_index(drop=True)
                    distances = np.sqrt(_squares(_matrix(part["vector"]), centres))
                    if bounded:
                        row, col = np.nonzero(distances - radius <= part["within"].to_numpy()[:, None] + slack)
                    else:  # the nearest cells that hold k rows together
                        near = distances.argsort(axis=1)
                        before = np.cumsum(counts[near], axis=1) - counts[near]
                        row, place = np.nonzero(before < k)
                        col = near[row, place]
                    copies = blocks[col]
                    row, col = np.repeat(row, copies), np.repeat(col, copies)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                    yield pd.DataFrame({
                        "query_id": part["query_id"].to_numpy()[row], "vector": part["vector"].to_numpy()[row],
                        "cell": cells[col], "piece": piece,
                    })

        return visit

    schema = "query_id bigint, vector array<double>, cell int, piece int"
    cut = (placed, list(zip(cells.tolist(), blocks.tolist())), k)
    first = _search_blocks(materialize(q.mapInPandas(visits(False), schema), "visits"), *cut)
    bounds = materialize(first.groupBy("query_id").agg(F.max("distance").alias("within")), "bounds")
    asked = materialize(q.join(bounds, "query_id"), "asked")
    visited, asking = _visited(asked, centres, radius, slack, blocks)
    if visited > most * asking:
        return _all_pairs(asked, placed, k, rows, width)
    return materialize(_search_blocks(materialize(asked.mapInPandas(visits(True), schema), "visits"), *cut), "neighbours", keep=1)


def _expected_visits(q: DataFrame, placed: DataFrame, centres: np.ndarray, radius: np.ndarray, slack: float, blocks: np.ndarray, k: int) -> float:
    """Blocks that a query has to visit on average, from a few queries and the true distances of their k-th neighbours."""
    queries = _matrix(q.orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(SAMPLED).select("vector").toPandas()["vector"])
    if not len(queries):
        return 0.0

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = _Nearest(queries, k)
        for batch in batches:
            nearest.meet(batch["train_id"].to_numpy(), _matrix(batch["vector"]), batch["y"].to_numpy())
        yield pd.DataFrame(nearest.found(np.arange(len(queries))))

    found = _first(placed.select("train_id", "vector", "y").mapInPandas(search, _FOUND), k)
    within = np.zeros(len(queries))
    for place, distance in found.groupBy("query_id").agg(F.max("distance")).collect():
        within[place] = distance
    return float(((np.sqrt(_squares(queries, centres)) - radius <= within[:, None] + slack) @ blocks).mean())


def _visited(asked: DataFrame, centres: np.ndarray, radius: np.ndarray, slack: float, blocks: np.ndarray) -> tuple[int, int]:
    """How many blocks all queries together have to visit, and the number of queries."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                distances = np.sqrt(_squares(_matrix(batch["vector"]), centres))
                yield pd.DataFrame({"n": (distances - radius <= batch["within"].to_numpy()[:, None] + slack) @ blocks}).astype("int64")

    total, asking = asked.mapInPandas(count, "n bigint").agg(F.sum("n"), F.count("*")).first()
    return total or 0, asking


def _pages(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """Rows (id, vector, number) packed into pages of raw bytes, each of so many rows of a task or of its last ones."""

    def page(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column(0).to_numpy() for b in held])
        vectors = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held])
        numbers = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held])
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (ids, vectors, numbers)], ["ids", "vectors", "numbers"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, rows - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == rows:
                    yield page(held)
                    held, n = [], 0
        if held:
            yield page(held)

    return df.select(*columns).mapInArrow(pack, "ids binary, vectors binary, numbers binary")


def _unpacked(ids: bytes, vectors: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, vectors, numbers = (np.frombuffer(p, t) for p, t in ((ids, np.int64), (vectors, np.float64), (numbers, np.float64)))
    return ids, vectors.reshape(len(ids), -1), numbers


def _all_pairs(asked: DataFrame, placed: DataFrame, k: int, rows: int, width: int) -> DataFrame:
    """Every query held against every row, some parts of the rows a round, so that tasks end and pages of all rows are never stored at once."""
    asked = asked.filter(F.col("query_id").isNotNull())
    asking, row_bytes = asked.count(), 8 * max(width, 1)
    part = max(1, min(PART_ROWS, PART_BYTES // row_bytes))
    rounds = max(1, -(-rows // (part * PARTS_AT_ONCE)))
    page = max(1, min(PAGE_ROWS, PAGE_BYTES // row_bytes))

    def nearest(last: int) -> DataFrame:
        with temporary(asked.sparkSession):
            before = nearest(last - 1) if last else None
            these = placed.filter(F.pmod(F.xxhash64("train_id"), F.lit(rounds)) == last)
            # Small row groups, since a reader holds one of them at a time.
            known = materialize(_pages(these, ["train_id", "vector", "y"], page), "known", **{"parquet.block.size": str(GROUP_BYTES)})
            found = _streamed(asked, known, k, asking, rows // rounds, width)
            best = _first(found if before is None else found.unionByName(before), k)
            return materialize(best, "neighbours", keep=2) if last == rounds - 1 else materialize(best, "best", keep=1)

    return nearest(rounds - 1)


def _streamed(asked: DataFrame, known: DataFrame, k: int, asking: int, rows: int, width: int) -> DataFrame:
    """The k nearest rows of the pages in each task: it holds its part of the queries and reads the pages past them, one after another.

    Where there are few queries, the pages are read in several cuts, each by tasks of its own.
    """
    tasks = 3 * max(asked.sparkSession.sparkContext.defaultParallelism, 1)
    part, at_once = (max(1, min(n, PART_BYTES // (8 * max(width, 1)))) for n in (PART_QUERIES, PART_ROWS))
    groups = max(1, -(-asking // part), min(tasks, -(-asking // _TILE_QUERIES)))
    cuts = max(1, min(tasks // groups, rows // PART_ROWS))
    place, packed = F.monotonically_increasing_id(), {"ids": "query_ids", "vectors": "query_vectors", "numbers": "within"}
    known = known.coalesce(cuts).withColumn("page", place)
    queries = _pages(asked.repartition(groups), ["query_id", "vector", "within"], part + part // 4).withColumn("group", place)
    # Of a Cartesian product the left side is streamed and the right one held. The queries go with the first page only, their group's name with all others.
    queries = queries.withColumn("whole", F.explode(F.array(F.lit(True), F.lit(False))))
    queries = queries.select("group", "whole", *[F.when(F.col("whole"), F.col(c)).alias(name) for c, name in packed.items()])
    first, whole = F.col("page").bitwiseAND(F.lit(2**33 - 1)) == 0, F.col("whole")
    pairs = known.hint("shuffle_replicate_nl").join(queries, (first & whole) | ~(first | whole)).select("page", "group", "ids", "vectors", "numbers", *packed.values())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, n, last = {}, [], 0, None

        def meet() -> None:
            ids, vectors, ys = (np.concatenate(p) for p in zip(*held))
            for _, nearest in groups.values():
                nearest.meet(ids, vectors, ys)

        for batch in batches:
            for row in range(batch.num_rows):
                page, group, *known = (batch.column(c)[row] for c in range(5))
                if batch.column(5)[row].is_valid:
                    ids, vectors, within = _unpacked(*(batch.column(c)[row].as_buffer().to_pybytes() for c in (5, 6, 7)))
                    groups[group.as_py()] = ids, _Nearest(vectors, k, within)
                if page.as_py() == last:  # the same page beside another group of queries
                    continue
                if n >= at_once:
                    meet()
                    held, n = [], 0
                last = page.as_py()
                held.append(_unpacked(*(p.as_buffer().to_pybytes() for p in known)))
                n += len(held[-1][0])
        if held:
            meet()
        for ids, nearest in groups.values():
            found = nearest.found(ids)
            yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in found], list(found))

    return pairs.mapInArrow(search, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query; the rows of a task are reduced to k of each query before they are shuffled."""
    best = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def _search_blocks(visits: DataFrame, placed: DataFrame, pieces: list[tuple[int, int]], k: int) -> DataFrame:
    """The k nearest rows over the blocks that each query visits. A block asked by many queries is copied to several groups."""
    spark = visits.sparkSession
    per_block = materialize(visits.groupBy("cell", "piece").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("groups")), "groups")
    small = F.broadcast(per_block) if per_block.count() <= BROADCAST_BLOCKS else per_block
    known_pieces = F.broadcast(spark.createDataFrame(pieces, "cell int, pieces int"))  # one row per pivot
    reference = (
        placed.join(known_pieces, "cell")
        .withColumn("piece", F.pmod(F.xxhash64("train_id"), F.col("pieces")).cast("int"))
        .join(small, ["cell", "piece"])
        .select("train_id", "vector", "y", "cell", "piece", F.explode(F.sequence(F.lit(1), F.col("groups"))).alias("copy"))
    )
    spread = visits.join(small, ["cell", "piece"]).select(
        "query_id", "vector", "cell", "piece",
        (F.pmod(F.xxhash64("query_id"), F.col("groups")) + 1).cast("int").alias("copy"),
    )

    def search(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(known):
            return pd.DataFrame({"query_id": [], "train_id": [], "distance": [], "y": []})
        return _nearest(
            asked["query_id"].to_numpy(), _matrix(asked["vector"]), known["train_id"].to_numpy(),
            _matrix(known["vector"]), known["y"].to_numpy(), k,
        )

    keys = ["cell", "piece", "copy"]
    found = spread.groupBy(*keys).cogroup(reference.groupBy(*keys)).applyInPandas(search, _FOUND)
    return _first(found, k)


def neighbor_regression(found: DataFrame) -> DataFrame:
    """Mean of the neighbours' values per query."""
    return found.groupBy("query_id").agg(F.avg("y").alias("prediction"))


def neighbor_classes(found: DataFrame, classes: int) -> DataFrame:
    """Vote shares per class and the majority class, the lower class among equals."""
    votes = found.groupBy("query_id").agg(
        F.array(*[F.avg((F.col("y") == c).cast("double")) for c in range(classes)]).alias("probability")
    )
    top = F.array_max("probability")
    return votes.select("query_id", (F.array_position("probability", top) - 1).cast("double").alias("prediction"), "probability")
