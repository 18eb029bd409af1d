"""Quality by supervised subword embeddings: a document is the mean of learned vectors of its words and parts of words.

Every word adds the row of its whole spelling, the rows of its character n-grams (its borders count as characters) and
one for it and the word before it. Rows are hashed into a table of fixed size; the pair of a word with
itself has a row of its own, so repetition shows whatever the word. A softmax layer over the mean vector gives the labels' shares.
Table and layer are learned together by stochastic gradient descent in numpy. Case and signs are kept, since they tell.

Since the layer is linear, a row's part in the score is one number after training, and a word's is a sum that is
kept while the word is remembered; scoring is a gather and a mean.

Training reads at most `per_label` rows of each label, the first by hash among rows that are not held out, with one text for each id (the
smallest where an id repeats). Tasks turn these texts into rows of the table; one task fits on them, and only the weights
(a few MB, whatever the input) come to the driver.

Defined results: null, empty and blank texts get the score of the layer's bias; null ids and null labels are not used for training;
without labels of both kinds every score is the smoothed share of ones. Rows that repeat are scored alike, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from residua.operators.storage import materialize

GRAMS, ROW_BITS, DIMENSIONS = (2, 3, 4), 17, 12
PER_LABEL, EPOCHS, RATE = 2400, 6, 4.0
REMEMBERED_WORDS, LONGEST_REMEMBERED, CHUNK_CHARS = 400_000, 40, 1_000_000
_ODD = np.random.default_rng(11).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(64 - ROW_BITS)


def _row(keys: np.ndarray, kind: int) -> np.ndarray:
    mixed = (keys + np.uint64(kind)) * _ODD[kind]
    return (((mixed ^ (mixed >> np.uint64(31))) * _ODD[0]) >> _SHIFT).astype(np.int64)


def spelling(words: list[str]) -> np.ndarray:
    """A 32-bit number of each word's whole spelling."""
    return np.fromiter((crc32(w.encode()) for w in words), np.uint64, len(words))


def pair_rows(spelled: np.ndarray) -> np.ndarray:
    """Rows of neighbouring words; all equal neighbours share one row, that of no difference."""
    return _row(spelled[1:] - spelled[:-1], 1)


def word_rows(words: list[str], spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, row) of each word's spelling and character n-grams."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))  # characters to the word's end
    numbers, rows = [np.arange(len(words))], [_row(spelled, 2)]
    for n in GRAMS:
        if len(letters) < n:
            continue
        key = np.zeros(len(letters) - n + 1, np.uint64)
        for k in range(n):
            key = key * _ODD[7] + letters[k:k + len(key)]
        inside = left[:len(key)] >= n
        numbers.append(owner[:len(key)][inside])
        rows.append(_row(key[inside], 2 + n - GRAMS[0] + 1))
    return np.concatenate(numbers), np.concatenate(rows)


def text_rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and their shares of all its rows."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    distinct = list(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(distinct)}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    spelled = spelling(distinct)
    numbers, rows = word_rows(distinct, spelled)
    pairs = pair_rows(spelled[at])
    met, where = np.unique(np.concatenate([rows, pairs]), return_inverse=True)
    weights = np.bincount(where, np.concatenate([np.bincount(at)[numbers], np.ones(len(pairs))]))
    return met, (weights / weights.sum()).astype(np.float32)


@dataclass
class Model:
    table: np.ndarray  # (rows, DIMENSIONS)
    layer: np.ndarray  # (DIMENSIONS, 2)
    bias: np.ndarray  # (2,)

    def row_scores(self) -> np.ndarray:
        """What each row adds to the logit of label 1 against label 0."""
        return (self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Fit table and layer on texts given as rows and shares."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (1 << ROW_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        share = (ones + 1) / (len(labels) + 2)
        return Model(np.zeros_like(table), layer, np.log(np.array([1 - share, share])).astype(np.float32))
    weight = {1: len(labels) / (2 * ones), 0: len(labels) / (2 * (len(labels) - ones))}
    order, step = np.arange(len(labels)), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for n in order:
            rate = RATE * (1 - step / (epochs * len(order)))
            step += 1
            rows, shares = texts[n]
            label = int(labels[n])
            mean = shares @ table[rows] if len(rows) else np.zeros(DIMENSIONS, np.float32)
            slope = softmax(mean @ layer + bias)
            slope[label] -= 1
            slope = (rate * weight[label] * slope).astype(np.float32)
            if len(rows):
                table[rows] -= shares[:, None] * (layer @ slope)
            layer -= 0.1 * np.outer(mean, slope)
            bias -= 0.01 * slope
    return Model(table, layer, bias)


class Scorer:
    """Logits of texts; what a word adds is remembered, for a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.rows = model.row_scores()
        self.bias = float(model.bias[1] - model.bias[0])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.long: list[str] = []
        self.added, self.counts, self.spelled = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _learn(self, words: set[str]) -> None:
        if len(self.counts) > REMEMBERED_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        self.known.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
        self.long = [w for w in new if len(w) > LONGEST_REMEMBERED]
        spelled = spelling(new)
        numbers, rows = word_rows(new, spelled)
        self.added = np.concatenate([self.added, np.bincount(numbers, self.rows[rows], len(new))])
        self.counts = np.concatenate([self.counts, np.bincount(numbers, minlength=len(new))])
        self.spelled = np.concatenate([self.spelled, spelled])

    def logits(self, texts: list[str]) -> np.ndarray:
        out, split = np.full(len(texts), self.bias), [t.split() for t in texts]
        self._learn(set().union(*split))
        for n, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                pairs = pair_rows(self.spelled[at])
                out[n] += (self.added[at].sum() + self.rows[pairs].sum()) / (self.counts[at].sum() + len(pairs))
        while self.long:
            del self.known[self.long.pop()]
        return out


def held_out(id_col: Column) -> Column:
    """Whether a row is never learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, per_label: int) -> DataFrame:
    """Stored `id`, `label`, `rows`, `shares` of the rows to learn from."""
    named = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    named = named.where("label in (0, 1) and id is not null").where(~held_out(F.col("id")))
    first = [named.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label) for value in (0, 1)]
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(first[0].union(first[1])), "id")  # at most 2 * per_label ids are sent
    chosen = chosen.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for n in range(batch.num_rows):
                rows, shares = text_rows(batch.column(2)[n].as_py())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(n, 1), batch.column(1).slice(n, 1),
                    pa.array([rows.astype(np.int32)], pa.list_(pa.int32())), pa.array([shares], pa.list_(pa.float32())),
                ], ["id", "label", "rows", "shares"])

    return materialize(chosen.mapInArrow(batches, "id long, label int, rows array<int>, shares array<float>"), "training")


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL,
    epochs: int = EPOCHS,
) -> Model:
    """Train in one task on the bounded sample."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts = [], [], []
        for batch in source:
            ids += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
            texts += [(r.values.to_numpy(), s.values.to_numpy()) for r, s in zip(batch.column(2), batch.column(3))]
        order = sorted(range(len(ids)), key=lambda n: (ids[n], marks[n]))
        model = train([texts[n] for n in order], np.array([marks[n] for n in order], np.int64), epochs)
        yield pa.RecordBatch.from_pydict({k: [getattr(model, k).tobytes()] for k in ("table", "layer", "bias")})

    sample = training_rows(df, labels, id_col, text, label, per_label)
    found = sample.coalesce(1).mapInArrow(batches, "table binary, layer binary, bias binary").first()
    if found is None:
        return train([], np.zeros(0, np.int64))
    read = lambda content, *shape: np.frombuffer(content, np.float32).reshape(shape)
    return Model(read(found["table"], -1, DIMENSIONS), read(found["layer"], DIMENSIONS, 2), read(found["bias"], 2))


def with_scores(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the score of each text; a column named like `out` is replaced, all others are kept."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # 2^ROW_BITS rows
    plain = df.drop(out)
    place = plain.columns.index(text)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in source:
            found, part, held = [], [], 0
            for value in batch.column(place):
                part.append(value.as_py() or "")
                held += len(part[-1])
                if held > CHUNK_CHARS:
                    found.append(scorer.logits(part))
                    part, held = [], 0
            found.append(scorer.logits(part))
            scores = 1 / (1 + np.exp(-np.clip(np.concatenate(found), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    return plain.mapInArrow(batches, StructType([*plain.schema.fields, StructField(out, DoubleType())]))


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", limit: float = 0.7,
    per_label: int = PER_LABEL,
) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of every row of `df`, learned from its labelled rows."""
    model = fit(df, labels, id_col, text, label, per_label)
    scored = with_scores(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
