"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

Documents with equal sets are one class from the start. Each class has 128 minima: bands of them name the
buckets in which candidates meet, and their low bits, packed in bit planes, estimate the similarity of a pair
by counting bits, corrected for chance collisions. A pair whose estimate could still reach the threshold is
confirmed on the whole sets.

No bucket emits all its pairs. First every member is compared with the smallest member of its buckets, then, in
a few rounds over shares of the buckets, with the most similar one of another component among its neighbours in the bucket's hashed order. Links
confirmed so far make components, and links inside a component cannot change the result. Only buckets that
still hold several components go on: there members outside the component of the smallest are compared with
members of other components by longer signatures, so that no link between components is lost.

Defined results: a null or wordless text has an empty set and links with nothing; a text of fewer than `k`
words has its whole sequence as its only shingle. Rows with a null id take no part: their component is null
and they are kept. Rows that repeat an id with different texts are documents of their own; a component is named by the smallest id in
it. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from residua.llm.components import connected_components
from residua.llm.row_keys import NUMBER, ids_are_unique, text_numbers, with_numbers
from residua.operators.storage import materialize

ROWS, BANDS, LOW_BITS = 4, 32, 2
MINIMA, LONG_MINIMA = ROWS * BANDS, 2048
PERCENT = 80
ROUNDS, NEIGHBOURS = 4, 64
#: Rows of a table of ids that may be broadcast: a few MB.
BROADCAST_ROWS = 400_000

_random = np.random.default_rng(20240607)
_FACTORS = _random.integers(0, 2**63, LONG_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, LONG_MINIMA, dtype=np.uint64)
_MIX = _random.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[salt]
    x = (x ^ (x >> np.uint64(29))) * _MIX[salt + 1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        shingles = np.array([_chain(hashes) ^ np.uint64(len(words))], np.uint64) if words else hashes
    else:
        n = len(words) - k + 1
        shingles = hashes[:n] * _MIX[8]
        for i in range(1, k):
            shingles = _mixed(shingles, 2) + hashes[i:n + i]
    return np.unique(_mixed(shingles, 4))


def _chain(hashes: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for h in hashes:
        out = _mixed(out, 6) + h
    return out[0]


def slack(n_minima: int) -> float:
    """How far an estimate may fall below the similarity it estimates: five standard deviations."""
    chance = 2.0**-LOW_BITS
    equal = PERCENT / 100 + (1 - PERCENT / 100) * chance
    return 5 * math.sqrt(equal * (1 - equal) / n_minima) / (1 - chance)


def minima(shingles: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """The smallest value of each of n hash functions over a set, 32 bits each."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        values = shingles[i:i + 1024, None] * _FACTORS[:n] + _SHIFTS[:n]
        np.minimum(out, values.min(axis=0), out=out)
    return out >> np.uint64(32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[9]
    for column in minima.reshape(BANDS, ROWS).T:
        keys = _mixed(keys, 10) + column
    return _mixed(keys, 12)


def bit_planes(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima: for each bit a plane of as many bits, as 64-bit words."""
    planes = [np.packbits(((minima >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)) for bit in range(LOW_BITS)]
    return np.concatenate(planes).view(np.uint64)


def plane_names(n: int) -> list[str]:
    return [f"p{i}" for i in range(LOW_BITS * n // 64)]


PLANES = plane_names(MINIMA)
SIGNATURE = "doc_id long, n_shingles long, set1 long, set2 long, " + ", ".join(f"{p} long" for p in PLANES) + ", bands array<long>"


def estimate(a: str, b: str, n: int = MINIMA) -> Column:
    """Estimated similarity of the sets behind two prefixed signatures, corrected for chance equality of low bits."""
    names, words, unequal = plane_names(n), n // 64, F.lit(0)
    for word in range(words):
        differ = None
        for bit in range(LOW_BITS):
            name = names[bit * words + word]
            one = F.col(f"{a}{name}").bitwiseXOR(F.col(f"{b}{name}"))
            differ = one if differ is None else differ.bitwiseOR(one)
        unequal = unequal + F.bit_count(differ)
    chance = 2.0**-LOW_BITS
    return ((1 - unequal / n) - chance) / (1 - chance)


def signatures(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ones, twos, planes, bands = [], [], [], [], []
            for value in batch.column(1):
                shingles = shingle_set(value.as_py(), k)
                low = minima(shingles)
                counts.append(len(shingles))
                ones.append(np.add.reduce(_mixed(shingles, 0), dtype=np.uint64).view(np.int64))
                twos.append(np.bitwise_xor.reduce(_mixed(shingles, 13)).view(np.int64) if len(shingles) else 0)
                planes.append(bit_planes(low).view(np.int64))
                bands.append(band_keys(low).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
            if not counts:
                continue
            words = np.array(planes)
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())]
                + [pa.array(words[:, i]) for i in range(len(PLANES))]
                + [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))],
                [c.split()[0] for c in SIGNATURE.split(", ")],
            )

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(sign, SIGNATURE)


def _of_ids(texts: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of `texts` with the given distinct ids; few ids are broadcast, so that no other text is moved. `most`: so many ids at most, if known."""
    few = most is not None and most <= BROADCAST_ROWS or ids.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity; `texts` has a text for each end. The result is stored."""
    pairs = materialize(pairs, "pairs")
    n = pairs.count()
    if not n:  # nothing to confirm: the driver need not plan and remember the joins of texts
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = _of_ids(texts, ids, most=2 * n)
    left, right = (texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            good = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if held[0] != b:
                    held = (b, shingle_set(text_b.as_py(), k))
                x, y = shingle_set(text_a.as_py(), k), held[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return materialize(joined.mapInArrow(check, "a long, b long"), "confirmed")


def long_signatures(texts: DataFrame, k: int) -> DataFrame:
    """Bit planes of many more minima, for the documents of undecided buckets."""
    names = plane_names(LONG_MINIMA)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                planes = np.array([bit_planes(minima(shingle_set(t.as_py(), k), LONG_MINIMA)).view(np.int64) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(planes[:, i]) for i in range(len(names)))], ["doc_id", *names])

    return texts.select("doc_id", "text").mapInArrow(sign, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def best_neighbours(rows: DataFrame) -> DataFrame:
    """For each member of an undecided bucket the most similar member of another component among the next
    `NEIGHBOURS` in the bucket's own hashed order; one row (a, b, similarity) per member and bucket at most."""
    words = MINIMA // 64

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            band, a, component = columns[:3]
            planes, n = np.stack(columns[3:], axis=1).view(np.uint64), len(band)
            best, partner = np.full(n, -1), np.zeros(n, np.int64)
            for step in range(1, min(NEIGHBOURS, n - 1) + 1):
                differ = planes[:-step] ^ planes[step:]
                equal = MINIMA - np.bitwise_count(differ[:, :words] | differ[:, words:]).sum(axis=1).astype(np.int64)
                equal[(band[:-step] != band[step:]) | (component[:-step] == component[step:])] = -1
                for mine, other, where in ((slice(None, -step), a[step:], equal), (slice(step, None), a[:-step], equal)):
                    better = where > best[mine]
                    best[mine][better], partner[mine][better] = where[better], other[better]
            found = best >= 0
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(partner[found]), pa.array(best[found])], ["a", "b", "equal"])
            held = [c[-NEIGHBOURS:] for c in columns]

    ordered = rows.select("band", "a", "component", *[f"a_{p}" for p in PLANES], F.xxhash64("a", "band").alias("place"))
    ordered = ordered.repartitionByRange("band", "place").sortWithinPartitions("band", "place").drop("place")
    return ordered.mapInArrow(scan, "a long, b long, equal long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` (smallest id reachable over links), `kept`, one row per input row."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if ids_are_unique(rows, "doc_id"):
        return _components(rows, "doc_id", "text", k, percent)
    numbers = text_numbers(rows, "doc_id", "text")
    found = _numbered_components(rows, numbers, k, percent)
    return with_numbers(rows, numbers, "doc_id", "text").select("doc_id", NUMBER).join(found, NUMBER).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _numbered_components(rows: DataFrame, numbers: DataFrame, k: int, percent: int) -> DataFrame:
    """`__number_of_row`, `n_shingles`, `component` (the smallest number reachable), `component_id` (its id) of each distinct (id, text)."""
    numbered = with_numbers(rows, numbers, "doc_id", "text").select(
        F.when(F.col("doc_id").isNotNull(), F.col(NUMBER)).alias("__taken"), NUMBER, "text"
    )
    once = materialize(numbered.dropDuplicates([NUMBER]), "numbered")
    found = _components(once.where("__taken is not null"), NUMBER, "text", k, percent).select(
        F.col("doc_id").alias(NUMBER), "n_shingles", F.col("component_id").alias("component")
    )
    # rows without an id link to nothing
    alone = signatures(once.where("__taken is null"), NUMBER, "text", k).select(
        F.col("doc_id").alias(NUMBER), "n_shingles", F.lit(None).cast("long").alias("component")
    )
    ids = numbers.select(F.col("__id").alias("component_id"), F.col(NUMBER).alias("component"))
    return found.unionByName(alone).join(ids, "component", "left")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of `df` that stay when one document of each component does, that with the smallest id; all columns stay.

    Rows equal in id and text are one document.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if ids_are_unique(rows, "doc_id"):
        gone = _components(rows, "doc_id", "text", k, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
        return df.join(gone, F.col(id_col).cast("bigint") == F.col("__gone"), "left_anti")
    numbers = text_numbers(rows, "doc_id", "text")
    gone = _numbered_components(rows, numbers, k, percent).where(F.col(NUMBER) != F.col("component")).select(F.col(NUMBER).alias("__gone"))
    keyed = with_numbers(df, numbers, id_col, text)
    return keyed.join(gone, F.col(NUMBER) == F.col("__gone"), "left_anti").select(*df.columns)


def _components(df: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """`near_duplicates` of documents that an id or number tells apart."""
    signed = materialize(signatures(df, id_col, text, k), "signatures")
    taking_part = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(taking_part.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = materialize(
        signed.select("doc_id", "n_shingles", "set1", "set2").join(classes, ["set1", "set2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")),
        "members",
    )
    # One row per class.
    first = classes.withColumnRenamed("rep", "doc_id")
    lead = taking_part.join(first, ["set1", "set2", "n_shingles", "doc_id"], "left_semi")
    lead = materialize(lead.select("doc_id", "bands", *PLANES), "leads")
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    planes = lead.select("doc_id", *PLANES)

    def prefixed(side: str) -> DataFrame:
        return planes.select(F.col("doc_id").alias(side), *[F.col(p).alias(f"{side}_{p}") for p in PLANES])

    banded = lead.select(F.explode("bands").alias("band"), F.col("doc_id").alias("a"))
    buckets = banded.groupBy("band").agg(F.min("a").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(banded.join(buckets, "band"), "buckets")
    could_reach = estimate("a_", "b_") >= percent / 100 - slack(MINIMA)

    stars = shared.where("a <> hub").select("a", F.col("hub").alias("b")).distinct()
    stars = stars.join(prefixed("a"), "a").join(prefixed("b"), "b").where(could_reach).select("a", "b")
    links = confirmed(stars, texts, k, percent)
    labels = connected_components(links)
    undecided = _of_several(_placed(shared.drop("hub"), labels)).join(prefixed("a"), "a")
    undecided = materialize(undecided, "undecided")
    if not undecided.isEmpty():
        for part in range(ROUNDS):  # a share of the buckets each; members meet others in each of their buckets
            here = _of_several(_placed(undecided.where(F.pmod("band", F.lit(ROUNDS)) == part), labels))
            near = best_neighbours(here).groupBy("a").agg(F.max_by("b", "equal").alias("b"), F.max("equal").alias("equal"))
            likely = (F.col("equal") / MINIMA - 2.0**-LOW_BITS) / (1 - 2.0**-LOW_BITS) >= percent / 100 - slack(MINIMA)
            more = confirmed(near.where(likely).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), texts, k, percent)
            if not more.isEmpty():
                links = links.union(more)
                labels = connected_components(links)
        left = materialize(_of_several(_placed(undecided, labels)).select("band", "a", "component", "outside"), "left")
        more = links.limit(0) if left.isEmpty() else confirmed(_crossing(left, texts, k, percent), texts, k, percent)
        if not more.isEmpty():
            labels = connected_components(links.union(more))

    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), kept.alias("kept"))


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with their component as known now."""
    known = labels.withColumnRenamed("node", "a")
    return rows.drop("component", "outside").join(known, "a", "left").withColumn("component", F.coalesce("component", "a"))


def _of_several(placed: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, and whether theirs is not the bucket's smallest."""
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(mixed.select("band", "low"), "band").withColumn("outside", F.col("component") != F.col("low")).drop("low")


def _crossing(undecided: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of different components in a bucket whose long signatures could reach the similarity."""
    members = undecided.select("band", "a", "component", "outside")
    signed = materialize(long_signatures(_of_ids(texts, undecided.select(F.col("a").alias("doc_id")).distinct()), k), "long_signatures")
    names = plane_names(LONG_MINIMA)
    mine = undecided.groupBy("a").agg(F.collect_set("band").alias("bands"))  # at most one for each band

    def side(name: str) -> DataFrame:
        planes = signed.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("a"), *[F.col(p).alias(f"{name}_{p}") for p in names])
        own = mine.join(planes, "a").withColumnRenamed("bands", f"{name}_bands")
        return members.withColumnsRenamed({"component": f"{name}_component", "outside": f"{name}_outside"}).join(own, "a").withColumnRenamed("a", name)

    # Each pair meets once: in the first band it shares, from the side outside, or from the larger id where both are.
    once = (~F.col("y_outside") | (F.col("x") > F.col("y"))) & (F.col("x_component") != F.col("y_component"))
    likely = estimate("x_", "y_", LONG_MINIMA) >= percent / 100 - slack(LONG_MINIMA)
    first = F.col("band") == F.array_min(F.array_intersect("x_bands", "y_bands"))
    found = side("x").where("x_outside").join(side("y"), "band").where(once & likely & first)
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
