"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of trained rows for the hash of all its bytes and the hashes of its beginnings and end, so parts
of words count too. In scripts written without blanks every character is a word. Filters over 1, 2 and 3 words run along the text; a filter's largest value in every
stretch of words and in the whole text are its two features, of which one linear layer makes the score. The
text is read whole. Thresholds are calibrated by language, where the language is guessed from the text's own
common words, and moved to 0.5.

Training reads all labelled rows, with one text for each id (the smallest where an id repeats). One task makes a first fit on at most
`per_label` of each label, chosen by hash; where there are more rows, tasks then go on from it over all of them, each by its own steps, and
their changes are averaged after each of a few rounds, an embedding row's over the tasks that met it. The class weights are those of all rows.
The thresholds are set by a fifth of the rows, chosen by hash, that these steps leave out, all of them counted by logit. Only weights and
counts come to the driver. Words are left out at random while training, so each toxic word counts by itself.

Defined results: null, empty and wordless texts get the score of the bias alone; null labels are not used for
training; without labels of both kinds every score is 0. Repeated rows are scored alike, one row each.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from residua.operators.storage import materialize

WIDTHS, FILTERS, DIMENSIONS, ROW_BITS, STRETCH = (1, 2, 3), 12, 16, 16, 32
PER_LABEL, EPOCHS, BATCH, SCORED_AT_ONCE = 2400, 10, 32, 1000
#: Passes of the first fit where all rows follow; their rounds and their rates; logits that are counted as one, and where they end.
FIRST_EPOCHS, ROUND_RATES, LOGIT_STEP, MOST_LOGIT = 4, (0.004, 0.002), 1 / 64, 64.0
FEATURES, KEPT_WORDS = 5, 0.6
_FIRST = {n: np.uint64((1 << 8 * n) - 1) for n in (4, 6)}
_ODD = np.random.default_rng(5).integers(0, 2**63, FEATURES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Common words by which a text's language is guessed.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with", "de": "der die und das von zu mit sich des auf",
    "fr": "le et les des un du est pour dans qui", "es": "el en y los del se las por una con",
}
LANGUAGES = [*LANGUAGE_WORDS, "other"]
_GUESS = {w.encode(): i for i, line in enumerate(LANGUAGE_WORDS.values()) for w in line.split()}
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)
#: Letters of scripts written without blanks: Thai, Lao, Tibetan, Burmese, Khmer, Han and kana.
_UNSPACED = re.compile("([\u0e00-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits, and single letters of scripts without blanks, as UTF-8."""
    low = (text or "").lower()
    if not low.isascii():
        low = _UNSPACED.sub(r" \1 ", low)
    return low.encode().translate(_LOWER).split()


def language_of(words: list[bytes]) -> int:
    """Place in LANGUAGES of the language whose common words are the most frequent."""
    counts = [0] * (len(LANGUAGES) - 1)
    for w in words:
        i = _GUESS.get(w)
        if i is not None:
            counts[i] += 1
    best = max(counts)
    return counts.index(best) if best else len(counts)


def rows_of(words: list[bytes]) -> np.ndarray:
    """Embedding rows of words, a line each: of the first 4, 6 and 8 bytes, of all bytes and of the last 4."""
    head = np.array(words, dtype="S8").view("<u8")
    whole = np.fromiter(map(crc32, words), np.uint64, len(words))
    end = np.array([w[-4:] for w in words], dtype="S8").view("<u8")
    keys = np.stack([head & _FIRST[4], head & _FIRST[6], head, whole * _ODD[3] + np.uint64(1), end], axis=1)
    return (((keys ^ (keys >> np.uint64(29))) * _ODD) >> np.uint64(64 - ROW_BITS)).astype(np.int64)


@dataclass
class Network:
    """Weights: embedding, filters[width] of shape (width * DIMENSIONS, FILTERS), their biases, output layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: np.ndarray  # logits by guessed language

    @staticmethod
    def fresh(seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        return Network(
            normal(1 << ROW_BITS, DIMENSIONS) * 0.1, [normal(w * DIMENSIONS, FILTERS) / np.sqrt(w * DIMENSIONS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(2 * FILTERS * len(WIDTHS)) * 0.1, 0.0, np.zeros(len(LANGUAGES)),
        )

    def word_table(self) -> np.ndarray:
        """What an embedding row adds at each place of each filter: scoring then only gathers and adds."""
        return np.concatenate(
            [self.embedding @ f[DIMENSIONS * k:DIMENSIONS * (k + 1)] for f, w in zip(self.filters, WIDTHS) for k in range(w)], axis=1
        )


def pooled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value per stretch, with its place; values has a row per word."""
    starts = np.arange(0, len(values), STRETCH)
    padded = np.full((len(starts) * STRETCH, values.shape[1]), -np.inf, np.float32)
    padded[: len(values)] = values
    places = padded.reshape(len(starts), STRETCH, -1).argmax(axis=1) + starts[:, None]
    return np.take_along_axis(values, places, 0), places


def logits(table: np.ndarray, network: Network, texts: list[list[bytes]]) -> np.ndarray:
    """Uncalibrated logits of texts given as words."""
    distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    ids = [np.fromiter(map(distinct.__getitem__, words), np.int64, len(words)) for words in texts]
    if distinct:
        rows = rows_of(list(distinct))
        per_word = table[rows[:, 0]]
        for i in range(1, FEATURES):
            per_word += table[rows[:, i]]
    return np.array([_logit(per_word[text], network) if len(text) else network.bias for text in ids])


def _logit(places: np.ndarray, network: Network) -> float:
    """Uncalibrated logit of a text given as what its words add at each place of each filter."""
    at, features = 0, []
    for f, width in enumerate(WIDTHS):
        length = max(1, len(places) - width + 1)
        values = np.zeros((length, FILTERS), np.float32)
        for k in range(width):
            part = places[k:k + length, FILTERS * at:FILTERS * (at + 1)]
            values[: len(part)] += part
            at += 1
        # The largest value stays the largest when a bias is added and what is below 0 is cut, so that is done once a stretch.
        stretches = np.maximum(np.maximum.reduceat(values, np.arange(0, length, STRETCH), axis=0) + network.biases[f], 0)
        features += [stretches.mean(axis=0), stretches.max(axis=0)]
    return network.bias + float(np.concatenate(features) @ network.output)


def train(rows: list[np.ndarray], languages: np.ndarray, labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit by Adam on the logistic loss, classes weighted evenly; then set each language's threshold.

    A text comes as the embedding rows of its words, a line each, and its place in LANGUAGES.
    """
    network = Network.fresh(seed)
    if len(set(labels.tolist())) < 2:
        network.bias = -np.inf
        return network
    rng = np.random.default_rng(seed)
    held = rng.random(len(rows)) < 0.2
    weights = class_weights(labels.mean())[labels]
    steps, order = Steps(network, rng), np.flatnonzero(~held)
    for epoch in range(epochs):
        rng.shuffle(order)
        steps.run(rows, labels, weights, order, 0.01 * (1 - epoch / (epochs + 1)))
    network.bias = float(steps.parameters[-1][0])
    table, found = network.word_table(), np.full(len(rows), network.bias)
    for n in np.flatnonzero(held):
        if len(rows[n]):
            found[n] = _logit(sum(table[rows[n][:, i]] for i in range(FEATURES)), network)
    every = _threshold(found[held], labels[held], np.ones(held.sum()), 0.0)
    for i in range(len(LANGUAGES)):
        here = (languages == i) & held
        network.thresholds[i] = _threshold(found[here], labels[here], np.ones(here.sum()), every)
    return network


def class_weights(share: float) -> np.ndarray:
    """Weights of rows with label 0 and 1, given the share of label 1."""
    return np.array([0.5 / (1 - share), 0.5 / share])


class Steps:
    """Adam steps that change a network's arrays in place; its bias is the last parameter."""

    def __init__(self, network: Network, rng: np.random.Generator) -> None:
        self.parameters = [network.embedding, *network.filters, *network.biases, network.output, np.full(1, network.bias, np.float32)]
        self.first, self.second = ([np.zeros_like(p) for p in self.parameters] for _ in range(2))
        self.gradients = [None, *(np.zeros_like(p) for p in self.parameters[1:])]  # the embedding's come by the rows met
        self.rng, self.step = rng, 0
        self.met = np.zeros(len(network.embedding), bool)

    def run(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, order: np.ndarray, rate: float) -> None:
        for at in range(0, len(order), BATCH):
            touched, pushes = [], []
            for n in order[at:at + BATCH]:
                kept = self.rng.random(len(rows[n])) < KEPT_WORDS  # so that no single word carries a text alone
                met, push = _backward(self.parameters, rows[n][kept], labels[n], weights[n], self.gradients)
                touched.append(met)
                pushes.append(push)
            self.step += 1
            used, found = _sums_by_row(np.concatenate(touched), np.concatenate(pushes))
            self.met[used] = True
            for i, (p, first, second) in enumerate(zip(self.parameters, self.first, self.second)):
                part, g = (used, found) if i == 0 else (slice(None), self.gradients[i])  # only the embedding rows that were met
                here = p[part]
                g /= BATCH
                g += np.float32(1e-6) * here
                one, two = first[part] * np.float32(0.9), second[part] * np.float32(0.99)
                one += np.float32(0.1) * g
                two += np.float32(0.01) * g * g
                first[part], second[part] = one, two
                p[part] = here - np.float32(rate / (1 - 0.9**self.step)) * one / (np.sqrt(two / np.float32(1 - 0.99**self.step)) + np.float32(1e-7))
                g[...] = 0


def _sums_by_row(rows: np.ndarray, pushes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of some words, a line of `rows` each, and the sum of the words' pushes for each row."""
    flat = rows.ravel()
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32)
    order = np.argsort(flat.astype(np.uint32), kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[starts], np.add.reduceat(pushes[order // FEATURES], starts, axis=0)


def _backward(parameters: list[np.ndarray], rows: np.ndarray, label: int, weight: float, gradients: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Add one text's gradients but for the embedding's, the first; returns the rows of the words it met, and what each adds to the gradients of its rows."""
    embedding, output = parameters[0], parameters[-2]
    if not len(rows):
        return rows, np.zeros((0, DIMENSIONS), np.float32)
    vectors = embedding[rows[:, 0]]
    for i in range(1, FEATURES):
        vectors += embedding[rows[:, i]]
    padded = np.concatenate([vectors, np.zeros((max(WIDTHS), DIMENSIONS), np.float32)])
    features, memory, every = [], [], np.arange(FILTERS)
    for f, width in enumerate(WIDTHS):
        length = max(1, len(vectors) - width + 1)
        values = sum(padded[k:k + length] @ parameters[1 + f][DIMENSIONS * k:DIMENSIONS * (k + 1)] for k in range(width))
        values = np.maximum(values + parameters[1 + len(WIDTHS) + f], 0)
        stretches, places = pooled(values)
        features += [stretches.mean(axis=0), stretches.max(axis=0)]
        memory.append((values, places, places[stretches.argmax(axis=0), every]))
    x = np.concatenate(features)
    slope = weight * (1 / (1 + np.exp(-np.clip(x @ output + parameters[-1][0], -30, 30))) - label)
    gradients[-2] += slope * x
    gradients[-1] += slope
    back = (slope * output).reshape(len(WIDTHS), 2, FILTERS).astype(np.float32)
    to_vectors = np.zeros_like(padded)
    for f, (width, (values, places, top)) in enumerate(zip(WIDTHS, memory)):
        flow = np.zeros_like(values)  # one word place per stretch, and the largest of all
        flow[places, every] = back[f, 0] / np.float32(len(places))
        flow[top, every] += back[f, 1]
        flow *= values > 0
        gradients[1 + len(WIDTHS) + f] += flow.sum(axis=0)
        for k in range(width):
            part = slice(DIMENSIONS * k, DIMENSIONS * (k + 1))
            gradients[1 + f][part] += padded[k:k + len(flow)].T @ flow
            to_vectors[k:k + len(flow)] += flow @ parameters[1 + f][part].T
    met = np.flatnonzero(to_vectors[: len(rows)].any(axis=1))
    return rows[met], to_vectors[met]


def _threshold(found: np.ndarray, labels: np.ndarray, rows: np.ndarray, otherwise: float) -> float:
    """The middle of the logits with the fewest errors on rows kept from training; `otherwise` with too few of them. `rows` counts equal ones."""
    ones, zeros = rows * (labels == 1), rows * (labels == 0)
    if ones.sum() < 5 or zeros.sum() < 5:
        return otherwise
    order, at = np.unique(found, return_inverse=True)
    cuts = np.concatenate([order[:1] - 1, (order[1:] + order[:-1]) / 2, order[-1:] + 1])
    missed = np.concatenate([[0], np.cumsum(np.bincount(at, ones))])
    errors = missed + zeros.sum() - np.concatenate([[0], np.cumsum(np.bincount(at, zeros))])
    best = np.flatnonzero(errors == errors.min())
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def held_out(id_col: Column) -> Column:
    """Whether a row is never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> Network:
    """Train on all labelled rows that are not held out; the first fit has at most `per_label` of each label, the first by hash."""
    named = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"))
    named = named.where("label in (0, 1) and id is not null").where(~held_out(F.col("id"))).distinct()
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    taught = texts.join(named, "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    taught = materialize(taught.withColumn("kept", F.pmod(F.xxhash64("id", F.lit("threshold")), F.lit(5)) == 0), "taught")
    counts = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = max(counts.values(), default=0) <= per_label or len(counts) < 2
    network = _first_fit(taught if few else taught.where("not kept"), per_label, EPOCHS if few else FIRST_EPOCHS)
    if few or not np.isfinite(network.bias):  # one label only among the rows to learn from
        return network
    return _calibrated(taught.where("kept"), _refined(taught.where("not kept"), network, counts[1] / (counts[0] + counts[1])))


def _first_fit(taught: DataFrame, per_label: int, epochs: int) -> Network:
    """Fit in one task on a bounded number of rows."""
    ids = taught.select("id", "label")
    first = [ids.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_label) for value in (0, 1)]
    chosen = taught.join(F.broadcast(first[0].union(first[1])), ["id", "label"]).select("id", "label", "text")  # at most 2 * per_label ids are sent

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for n in range(batch.num_rows):
                words = words_of(batch.column(2)[n].as_py())
                rows = rows_of(words).astype(np.int32).ravel() if words else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(n, 1), batch.column(1).slice(n, 1), pa.array([language_of(words)], pa.int32()), pa.array([rows], pa.list_(pa.int32()))],
                    ["id", "label", "language", "rows"],
                )

    def learned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in source:
            rows = [r.values.to_numpy().reshape(-1, FEATURES) for r in batch.column(3)]
            found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), rows)
        found.sort(key=lambda r: r[:2])
        network = train([r[3] for r in found], np.array([r[2] for r in found], np.int64), np.array([r[1] for r in found], np.int64), epochs=epochs)
        yield pa.RecordBatch.from_pydict({"network": [pickle.dumps(network)]})

    sample = materialize(chosen.mapInArrow(hashed, "id long, label int, language int, rows array<int>"), "training")
    fitted = sample.coalesce(1).mapInArrow(learned, "network binary").first()
    return pickle.loads(fitted["network"]) if fitted else train([], np.zeros(0, np.int64), np.zeros(0, np.int64))


def _refined(taught: DataFrame, network: Network, share: float) -> Network:
    """Go on over all rows, a part of them a round: tasks step on their own, then their changes are averaged."""
    context, weights = taught.sparkSession.sparkContext, class_weights(share)
    for n, rate in enumerate(ROUND_RATES):
        sent = context.broadcast(network)

        def learned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps = Steps(pickle.loads(pickle.dumps(sent.value)), np.random.default_rng(n))
            rows = 0
            for batch in source:
                for part in (batch.slice(i, SCORED_AT_ONCE) for i in range(0, batch.num_rows, SCORED_AT_ONCE)):
                    words = [words_of(t.as_py()) for t in part.column(1)]
                    texts, labels = [rows_of(w) if w else np.zeros((0, FEATURES), np.int64) for w in words], part.column(0).to_numpy()
                    steps.run(texts, labels, weights[labels], steps.rng.permutation(len(texts)), rate)
                    rows += len(texts)
            if rows:
                before, met = Steps(sent.value, steps.rng).parameters, np.flatnonzero(steps.met)
                changes = [steps.parameters[0][met] - before[0][met], *(a - b for a, b in zip(steps.parameters[1:], before[1:]))]
                yield pa.RecordBatch.from_pydict({"changes": [pickle.dumps((rows, met, changes))]})

        def averaged(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rows, by_row = None, 0, np.zeros((len(sent.value.embedding), 1))
            for batch in source:
                for value in batch.column(0):
                    count, met, changes = pickle.loads(value.as_py())
                    total = total or [np.zeros(sent.value.embedding.shape), *(np.zeros(c.shape) for c in changes[1:])]
                    rows += count
                    by_row[met] += count
                    total[0][met] += count * changes[0]
                    for t, c in zip(total[1:], changes[1:]):
                        t += count * c
            if total:
                means = [total[0] / np.maximum(by_row, 1), *(t / rows for t in total[1:])]
                yield pa.RecordBatch.from_pydict({"changes": [pickle.dumps([m.astype(np.float32) for m in means])]})

        part = taught.where(F.pmod(F.xxhash64("id", F.lit("round")), F.lit(len(ROUND_RATES))) == n).select("label", "text")
        part = part.coalesce(max(context.defaultParallelism, 1)).mapInArrow(learned, "changes binary")  # changes of one task are at most the network
        found = part.repartition(1).mapInArrow(averaged, "changes binary").first()
        sent.destroy()
        if found:
            moved = [p + c for p, c in zip(Steps(network, np.random.default_rng(n)).parameters, pickle.loads(found["changes"]))]
            w = len(WIDTHS)
            network = Network(moved[0], moved[1:1 + w], moved[1 + w:1 + 2 * w], moved[-2], float(moved[-1][0]), network.thresholds)
    return network


def _calibrated(kept: DataFrame, network: Network) -> Network:
    """Set the thresholds by all rows kept from the steps: their logits are counted in narrow steps, by language and label."""
    sent = kept.sparkSession.sparkContext.broadcast(network)

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value, sent.value.word_table()
        for batch in source:
            for part in (batch.slice(i, SCORED_AT_ONCE) for i in range(0, batch.num_rows, SCORED_AT_ONCE)):
                texts = [words_of(t.as_py()) for t in part.column(1)]
                place = np.rint(np.clip(logits(table, model, texts), -MOST_LOGIT, MOST_LOGIT) / LOGIT_STEP).astype(np.int64)
                columns = [part.column(0), pa.array([language_of(t) for t in texts], pa.int32()), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["label", "language", "place"])

    rows = kept.select("label", "text").mapInArrow(counted, "label int, language int, place long")
    found = rows.groupBy("label", "language", "place").agg(F.count("*").alias("n")).collect()  # at most all steps by language and label
    sent.destroy()
    labels, languages, places, n = (np.array(c) for c in zip(*found)) if found else (np.zeros(0),) * 4
    every = _threshold(places * LOGIT_STEP, labels, n, 0.0)
    for i in range(len(LANGUAGES)):
        here = languages == i
        network.thresholds[i] = _threshold(places[here] * LOGIT_STEP, labels[here], n[here], every)
    return network


def with_scores(df: DataFrame, network: Network, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the score of each text; a column named like `out` is replaced, all others are kept.

    The network is a few MB and goes out as a broadcast variable; tasks make the larger word table of it.
    """
    sent = df.sparkSession.sparkContext.broadcast(network)
    plain = df.drop(out)
    place = plain.columns.index(text)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value, sent.value.word_table()
        for batch in rows:
            for part in (batch.slice(i, SCORED_AT_ONCE) for i in range(0, batch.num_rows, SCORED_AT_ONCE)):
                texts = [words_of(t.as_py()) for t in part.column(place)]
                found = logits(table, model, texts) - model.thresholds[[language_of(t) for t in texts]]
                with np.errstate(over="ignore"):
                    scores = pa.array(1 / (1 + np.exp(-found)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, out])

    return plain.mapInArrow(batches, StructType([*plain.schema.fields, StructField(out, DoubleType())]))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of every row of `df`, learned from its labelled rows."""
    network = fit(df, labels, id_col, text, label)
    scored = with_scores(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), network)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
