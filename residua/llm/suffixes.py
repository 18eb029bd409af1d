"""Removal of long repeated passages by a sparse suffix array.

Every string of `width` bytes is filed under one place in it: the start of its smallest hashed `GRAM` bytes (an
anchor). Equal strings have the same anchor at the same offset, so repeats are found among the suffixes that
start at anchors with equal grams. Of those, equal surroundings are one class, whose strings all repeat; the
rest are sorted group by group: the bytes after the anchor, and the bytes before it read backwards, each by
multikey quicksort down to a shallow depth, below which blind tries order the groups that still agree. The
common prefixes of both orders give, for every pair in a group, the strings they share.

A group of many different surroundings is not taken into one task: its strings are compared by 128-bit hashes,
which are combined before and counted after a shuffle. Texts are read in bounded stretches, so memory does not
grow with their length; only offsets and hashes of candidates, and their surroundings, are moved.

Defined results: a null text counts as empty; texts shorter than `width` lose nothing. Rows that repeat an id
are rows of their own, so rows with equal texts repeat each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from residua.operators.storage import materialize

WIDTH, GRAM = 400, 64
#: Bytes handled at once, of one text or several; places in them fit the low bits of an ordering value.
STRETCH, PLACE_BITS = 1 << 19, 20
SHALLOW, CHUNK = 96, 8
#: Groups with more classes than this are counted by hashes instead of being sorted in one task.
MOST_SORTED = 2048
#: Parts in which a larger group's surroundings are dealt out.
SHARES = 1024

_random = np.random.default_rng(41)
_BASES = [int(x) * 2 + 1 for x in _random.integers(1 << 40, 1 << 62, 2)]
_BYTE_VALUES = _random.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _random.integers(0, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefixes:
    """Hashes of any stretch of a buffer, from running sums."""

    _powers_known: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray) -> None:
        if not self._powers_known or len(self._powers_known[0][0]) <= len(data):
            n = max(len(data) + 1, STRETCH + (1 << 16))
            self._powers_known[:] = [(_powers(b, n), _powers(pow(b, -1, 1 << 64), n)) for b in _BASES]
        self.sums = []
        for values, (_, inverse) in zip(_BYTE_VALUES, self._powers_known):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * inverse[: len(data)], dtype=np.uint64)]))

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        return _mixed((self.sums[which][ends] - self.sums[which][starts]) * self._powers_known[which][0][starts])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima inside blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(pieces: list[bytes], width: int) -> dict[str, np.ndarray]:
    """Anchors of all strings of `width` bytes inside each piece: the piece, the anchor's place, the first and
    last start of strings filed there, the gram's hash and two hashes of the surroundings."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    prefixes = Prefixes(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = prefixes.of(places, places + GRAM, 0)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_minimum((grams & ~low) | places.astype(np.uint64), width - GRAM + 1)
    starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(bounds[:-1], bounds[1:]) if b - a >= width])
    piece = np.searchsorted(bounds, starts, side="right") - 1
    at = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    at, piece = at[new], piece[new]
    shape = ((at - first) * 4096 + (last - first)).astype(np.uint64) * _ODD[2]
    around = [prefixes.of(first, last + width, i) + shape for i in (0, 1)]
    base = bounds[piece]
    return {"piece": piece, "at": at - base, "first": first - base, "last": last - base, "gram": grams[at], "c1": _mixed(around[0]), "c2": _mixed(around[1])}


def _stretches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Pieces of texts, together of bounded size; a long text's pieces share width - 1 bytes. Rows: (id, hash, offset)."""
    rows, pieces, held = [], [], 0
    for batch in batches:
        for doc, text_hash, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = (value.as_py() or "").encode()
            for offset in range(0, len(data) - width + 1, STRETCH):
                piece = data[offset : offset + STRETCH + width - 1]
                if held and held + len(piece) > STRETCH + width:
                    yield rows, pieces
                    rows, pieces, held = [], [], 0
                rows.append((doc, text_hash, offset))
                pieces.append(piece)
                held += len(piece)
    if pieces:
        yield rows, pieces


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Inner nodes [depth, children by the byte there]; leaves are numbers of strings. A string's end counts as byte -1."""

    def __init__(self, strings: list[bytes], first: int) -> None:
        self.strings, self.top = strings, first

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, number: int) -> None:
        s, node = self.strings[number], self.top
        while not isinstance(node, int):  # blind: only branching bytes are looked at, any leaf below will do
            children = node[1]
            node = children.get(self._byte(s, node[0]), next(iter(children.values())))
        other = self.strings[node]
        depth = common_prefix(s, other)
        above, edge, node = None, None, self.top
        while not isinstance(node, int) and node[0] < depth:
            above, edge = node, self._byte(s, node[0])
            node = node[1][edge] if edge in node[1] else None
            if node is None:
                above[1][edge] = number
                return
        if not isinstance(node, int) and node[0] == depth and (depth < len(s) or depth < len(other)):
            edge = self._byte(s, depth)
            if edge in node[1]:
                raise AssertionError("a blind descent missed a branch")
            node[1][edge] = number
            return
        if depth == len(s) == len(other):
            raise ValueError("equal strings")
        branch = [depth, {self._byte(s, depth): number, self._byte(other, depth): node}]
        if above is None:
            self.top = branch
        else:
            above[1][edge] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.top]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def sorted_order(strings: list[bytes]) -> list[int]:
    """Deep-shallow order: multikey quicksort by chunks down to a shallow depth, then blind tries. Equal strings stay together."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out.append(group[0])
        elif depth >= SHALLOW:
            distinct: dict[bytes, list[int]] = {}
            for n in group:
                distinct.setdefault(strings[n], []).append(n)
            heads = [same[0] for same in distinct.values()]
            trie = BlindTrie(strings, heads[0])
            for n in heads[1:]:
                trie.add(n)
            out += [n for head in trie.order() for n in distinct[strings[head]]]
        else:
            keys = {n: strings[n][depth : depth + CHUNK] for n in group}
            pivot = keys[group[len(group) // 2]]
            less, equal, more = ([n for n in group if keys[n] < pivot], [n for n in group if keys[n] == pivot], [n for n in group if keys[n] > pivot])
            if more:
                stack.append((more, depth))
            stack.append((equal, depth + CHUNK if len(pivot) == CHUNK else SHALLOW))
            if less:
                stack.append((less, depth))
    return out


def pairwise_prefixes(strings: list[bytes]) -> np.ndarray:
    """Common prefix lengths of all pairs, as minima over the lengths between neighbours in sorted order."""
    order, n = sorted_order(strings), len(strings)
    beside = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])] or [0], np.int64)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[order[i], order[i + 1 :]] = np.minimum.accumulate(beside[i:])
    return out + out.T


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def shared_spans(surroundings: list[bytes], before: list[int], width: int) -> list[tuple[list[int], list[int]]]:
    """For each of several surroundings of one gram (anchor `before` bytes in): starts and ends of bytes in strings shared with another."""
    ahead = pairwise_prefixes([s[b:] for s, b in zip(surroundings, before)])
    behind = pairwise_prefixes([s[:b][::-1] for s, b in zip(surroundings, before)])
    out = []
    for i, (s, b) in enumerate(zip(surroundings, before)):
        # A string starting `back` bytes before the anchor is shared if back <= behind and width - back <= ahead.
        low, high = np.maximum(width - ahead[i], 0), np.minimum(behind[i], b)
        low[i] = width + 1
        good = np.flatnonzero(low <= high)
        places = len(s) - width + 1
        steps = np.zeros(places + 1, np.int64)
        first, last = np.clip(b - high[good], 0, places), np.clip(b - low[good] + 1, 0, places)
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
        starts, ends = runs(np.cumsum(steps[:-1]) > 0)
        out.append((starts.tolist(), (ends + width - 1).tolist()))
    return out


SPANS = "gram long, c1 long, c2 long, starts array<int>, ends array<int>"
SURROUNDINGS = "gram long, c1 long, c2 long, before int, around binary, share int"


def _sorted_groups(width: int):
    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: dict[tuple, tuple[bytes, int]] = {}
        gram = None

        def close() -> None:
            if len(group) > 1:
                found = shared_spans([s for s, _ in group.values()], [b for _, b in group.values()], width)
                rows.extend((gram, *key, *spans) for key, spans in zip(group, found) if spans[0])

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["gram", "c1", "c2", "starts", "ends"])

        for batch in batches:
            batch = batch.filter(pc.equal(batch.column(5), 0))  # here, so that all who read the shuffled rows share them
            for g, c1, c2, before, around in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if g != gram:
                    close()
                    group, gram = {}, g
                group[(c1, c2)] = (around, before)
            if rows:
                yield flushed()
        close()
        if rows:
            yield flushed()

    return spans_of


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(texts with their keys, spans by key): spans are arrays of offsets, starts and ends, of repeated bytes; they may overlap."""
    least = F.lit(-(2**63)).cast("bigint")
    texts = df.select(
        F.coalesce(F.col(id_col).cast("bigint"), least).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).select("id", F.xxhash64("text").alias("text_hash"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pieces in _stretches(batches, width):
            found = anchors(pieces, width)
            owner = [rows[p] for p in found["piece"]]
            offset = np.array([r[2] for r in owner], np.int64)
            columns = [pa.array([r[0] for r in owner], pa.int64()), pa.array([r[1] for r in owner], pa.int64())]
            columns += [pa.array(found[c] + offset) for c in ("at", "first", "last")]
            columns += [pa.array(found[c].view(np.int64)) for c in ("gram", "c1", "c2")]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "at", "first", "last", "gram", "c1", "c2"])

    every = materialize(texts.mapInArrow(find, "id long, text_hash long, at long, first long, last long, gram long, c1 long, c2 long"), "anchors")
    # Stored, so that both sides of the join are shuffled for it and a hot gram can be split.
    again = materialize(every.groupBy("gram").count().where("count > 1").select("gram"), "again")
    candidates = materialize(every.join(again, "gram"), "candidates")
    classes = candidates.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_hash", "at", "first", "last")).alias("one"))
    groups = classes.groupBy("gram").agg(F.count("*").alias("classes"), F.min("n").alias("fewest"))
    classes = materialize(classes.join(groups, "gram").select("gram", "c1", "c2", "n", "classes", "fewest", "one.*"), "classes")

    zero = F.array(F.lit(0))
    whole = classes.where("n > 1").select("gram", "c1", "c2", zero.alias("starts"), F.array((F.col("last") - F.col("first") + width).cast("int")).alias("ends"))
    # Surroundings are needed where a class that occurs once may share strings with another class.
    asked = classes.where("classes > 1 and fewest = 1").groupBy("id", "text_hash").agg(
        F.collect_list(F.struct("gram", "c1", "c2", "at", "first", "last", (F.col("classes") > MOST_SORTED).alias("many"))).alias("asked")
    )
    # One shuffle has the surroundings for both ways of comparing them, so that whole texts are not moved again; large groups are dealt to many tasks.
    fetched = texts.join(asked, ["id", "text_hash"]).select("text", "asked").mapInArrow(_fetch(width), SURROUNDINGS).repartition("gram", "share")
    spans = whole.unionByName(fetched.sortWithinPartitions("gram").mapInArrow(_sorted_groups(width), SPANS))
    if not classes.where((F.col("classes") > MOST_SORTED) & (F.col("fewest") == 1)).isEmpty():
        strings = fetched.mapInArrow(_string_hashes(width), "h1 long, h2 long, gram long, c1 long, c2 long, place int")
        shared = strings.groupBy("h1", "h2").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).where("low < high").select("h1", "h2")
        places = strings.join(shared, ["h1", "h2"], "left_semi").groupBy("gram", "c1", "c2").agg(F.collect_set("place").alias("starts"))
        spans = spans.unionByName(places.withColumn("ends", F.transform("starts", lambda p: p + width)))
    placed = candidates.select("id", "text_hash", "first", "gram", "c1", "c2").join(spans, ["gram", "c1", "c2"])
    moved = lambda name: F.transform(name, lambda x: x + F.col("first"))
    by_text = placed.select("id", "text_hash", moved("starts").alias("starts"), moved("ends").alias("ends")).groupBy("id", "text_hash").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    return texts, by_text


def _fetch(width: int):
    """Surroundings asked of each text; `share` is 0 in groups that are sorted, which one task takes, and from 1 on in large ones."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, asked in zip(batch.column(0), batch.column(1)):
                data, every = value.as_py().encode(), asked.as_py()
                for wanted in (every[i : i + 200] for i in range(0, len(every), 200)):
                    columns = [pa.array([a[c] for a in wanted], pa.int64()) for c in ("gram", "c1", "c2")]
                    columns.append(pa.array([a["at"] - a["first"] for a in wanted], pa.int32()))
                    columns.append(pa.array([data[a["first"] : a["last"] + width] for a in wanted], pa.binary()))
                    columns.append(pa.array([1 + a["c2"] % SHARES if a["many"] else 0 for a in wanted], pa.int32()))
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "c1", "c2", "before", "around", "share"])

    return fetch


def _string_hashes(width: int):
    """128-bit hashes of every string filed under the anchors of large groups."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large = batch.filter(pc.greater(batch.column(5), 0))
            for part in (large.slice(i, 200) for i in range(0, large.num_rows, 200)):
                pieces = part.column(4).to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                counts = np.array([len(p) - width + 1 for p in pieces])
                places = np.concatenate([np.arange(c) for c in counts])
                starts = places + np.repeat(bounds[:-1], counts)
                prefixes = Prefixes(np.frombuffer(b"".join(pieces), np.uint8))
                columns = [pa.array(prefixes.of(starts, starts + width, i).view(np.int64)) for i in (0, 1)]
                columns += [pa.array(np.repeat(part.column(c).to_numpy(), counts)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(places.astype(np.int32))], ["h1", "h2", "gram", "c1", "c2", "place"])

    return hashes


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """One row per text: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, and the kept bytes if asked for."""
    texts, spans = repeated_spans(df, id_col, text, width)
    joined = texts.join(spans, ["id", "text_hash"], "left").select("id", "text", "starts", "ends")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                data = value.as_py().encode()
                merged: list[list[int]] = []
                for a, b in sorted(zip(starts.as_py() or (), ends.as_py() or ())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((
                    None if doc == -(2**63) else doc, len(data), len(data) - len(kept), len(merged),
                    hashlib.sha256(kept).hexdigest(), kept if with_text else None,
                ))
            if rows:
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    out = joined.mapInArrow(cut, schema)
    return out if with_text else out.drop("kept")
