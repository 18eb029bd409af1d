"""Alignment of two tokenizers' tokens over the same bytes, as Arrow columns from the ids to the counts.

Tasks cut their documents into blocks of bounded size. In a block the ids of both tokenizers are list columns; flattened, with
the document of each id beside it, their byte lengths give by a cumulative sum per document the place where each token
ends. A hash join on (document, end) finds the places where both end, which cut the text into groups. The outer
rows of the same join are the places where only one ends; each place in order closes one stretch that lies in
exactly one token of either side, so it is one link. Each block counts its pairs of ids once; Spark adds these partial
counts over all blocks, marks the pairs that are the most frequent of their B id (at most as many as B has
ids, so these are broadcast), and joins the sums back to the blocks' pairs, never to single links. A
last pass over each block adds them up per document.

Defined results: a null or empty text, or one that either vocabulary can't give back byte by byte, has no tokens: zeros and an empty
digest. Rows that repeat a document count as often as they are there. A text is never cut, so a very long one is a block of its own. An
empty table gives no rows. Special tokens inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from residua.llm.bpe import byte_letters
from residua.operators.storage import materialize

#: Characters of a block, of its documents that are aligned at a time, and of the words that are encoded at a time.
BLOCK_CHARS, ALIGNED_CHARS, ENCODED_CHARS = 2_000_000, 250_000, 100_000
REMEMBERED_WORDS, LONGEST_REMEMBERED = 300_000, 40
#: How pieces write a blank.
BLANK = "\u2581"
ODD_BLANKS, WORD_BORDERS = re.compile(r"\s ").search, re.compile(r"(?<=\S)(?= )").split
_SHIFT = 32
_PAIRS: dict[tuple[str, str], "Vocabularies"] = {}
_IDS = pa.large_list(pa.int32())


class Vocabularies:
    """Both tokenizers, with the bytes and the decimal text of each id, and the ids of the words met lately.

    A word is what follows, blank included, a blank behind a character that is no white space. Neither the byte-level word
    pattern nor a piece vocabulary without blanks inside pieces ever looks across such a border, so a text's ids are
    those of its words. With other pieces, texts go to the libraries whole.
    """

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED_WORDS) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        letters, special = byte_letters(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        entries = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            bytes_a[i] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.lengths = [pc.binary_length(x) for x in self.bytes]
        self.names = [pa.array(map(str, range(len(x))), pa.large_string()) for x in (bytes_a, bytes_b)]
        self.by_words = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.passing: list[str] = []
        self.words = [pa.array([], _IDS), pa.array([], _IDS)]

    def split(self, text: str) -> list[str]:
        """The words of a blank and a text; the blank before each is left out."""
        if not text:
            return []
        if not self.by_words:
            return [text]
        if ODD_BLANKS(" " + text):
            return [word[1:] for word in WORD_BORDERS(" " + text)]
        return text.split(" ")

    def _learn(self, words: set[str]) -> None:
        """Encode the words not known yet, a few at a time; very long ones are known for one call only."""
        while self.passing:
            del self.known[self.passing.pop()]
        if len(self.words[0]) > self.remembered:
            self._forget()
        for part in parts_of([w for w in words if w not in self.known], ENCODED_CHARS):
            self.known.update(zip(part, range(len(self.words[0]), len(self.words[0]) + len(part))))
            self.passing += [w for w in part if len(w) > LONGEST_REMEMBERED]
            found = self.a.encode_batch_fast([" " + w for w in part], add_special_tokens=False)
            pieces = self.b.encode(part, num_threads=1)
            if "" in part:  # a blank at the end of a text; the library adds none to an empty one
                pieces[part.index("")] = [self.b.piece_to_id(BLANK)]
            new = pa.array([e.ids for e in found], _IDS), pa.array(pieces, _IDS)
            self.words = [pa.concat_arrays(pair) for pair in zip(self.words, new)]

    def encode(self, texts: list[str]) -> list[pa.Array]:
        """The ids of both tokenizers, a list per text."""
        split = [self.split(t) for t in texts]
        self._learn(set().union(*split))
        places = pa.array(np.fromiter((i for words in split for i in map(self.known.__getitem__, words)), np.int64))
        ends = np.cumsum([0, *map(len, split)])
        out = []
        for side in self.words:
            lists = side.take(places)
            out.append(pa.LargeListArray.from_arrays(lists.offsets.take(pa.array(ends)), lists.values))
        return out


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Vocabularies(path_a, path_b)
    return _PAIRS[path_a, path_b]


def parts_of(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts of about `most` characters in all."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text) + 1
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def token_ends(ids: pa.Array, lengths: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The flattened ids, and the key (document, byte where the token ends) of each: a cumulative sum per document."""
    flat, document = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(pc.cast(lengths.take(flat), pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running])
    start = before.take(ids.offsets[:-1])
    ends = pc.subtract(running, start.take(document))
    return flat, pc.add(pc.shift_left(pc.cast(document, pa.int64()), pa.scalar(_SHIFT, pa.int64())), ends)


def joined(values: pa.Array, offsets: pa.Array, separator: str | bytes) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pc.cast(offsets, pa.int64()), values), pa.scalar(separator, values.type))


def _offsets(counts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(counts, pa.int64()))])


def _counted(document: pa.Array, rows: int) -> pa.Array:
    """How often each of the documents 0 to rows - 1 occurs."""
    counts = pa.table({"document": document}).group_by("document", use_threads=False).aggregate([([], "count_all")])
    out = np.zeros(rows, np.int64)
    out[counts["document"].to_numpy()] = counts["count_all"].to_numpy()
    return pa.array(out)


def align(ids: list[pa.Array], tables: Vocabularies) -> dict[str, pa.Array]:
    """Groups and links of documents whose ids on both sides spell the same bytes.

    Returns n_groups and n_links per document, the text of its groups, and all links in order as (a << 32) + b.
    """
    sides = []
    for name, side, lengths in zip("ab", ids, tables.lengths):
        flat, key = token_ends(side, lengths)
        sides.append((flat, pa.table({"key": key, name: pa.array(np.arange(len(flat)))})))
    (flat_a, left), (flat_b, right) = sides
    places = left.join(right, "key", join_type="full outer", use_threads=False)
    places = places.take(pc.sort_indices(places["key"])).combine_chunks()
    key, a, b = (places[c].combine_chunks() for c in ("key", "a", "b"))
    document = pc.shift_right(key, pa.scalar(_SHIFT, pa.int64()))
    shared = pc.and_(a.is_valid(), b.is_valid())
    n = len(ids[0])
    n_groups = _counted(document.filter(shared), n)
    texts = []
    for place, flat, names in ((a, flat_a, tables.names[0]), (b, flat_b, tables.names[1])):
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.add(pc.cast(place.filter(shared), pa.int64()), 1)])
        texts.append(joined(names.take(flat), offsets, ","))
    groups = pc.binary_join_element_wise(texts[0], texts[1], pa.scalar("|", pa.large_string()))
    id_a, id_b = (pc.cast(flat.take(pc.fill_null_backward(place)), pa.int64()) for flat, place in ((flat_a, a), (flat_b, b)))
    return {
        "n_groups": n_groups, "n_links": _counted(document, n), "groups": joined(groups, _offsets(n_groups), ";"),
        "links": pc.add(pc.shift_left(id_a, pa.scalar(_SHIFT, pa.int64())), id_b),
    }


_ROWS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_STORED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, "
    "pairs array<long>, counts array<long>"
)


def spelled(texts: list[str], ids: list[pa.Array], tables: Vocabularies) -> np.ndarray:
    """Which texts have tokens: both sides' ids give a blank and the text back byte by byte."""
    wanted = pa.array([(" " + t).encode() for t in texts], pa.large_binary())
    same = np.array([bool(t) for t in texts])
    for content, side in zip(tables.bytes, ids):
        same &= pc.equal(joined(content.take(pc.list_flatten(side)), side.offsets, b""), wanted).to_numpy(zero_copy_only=False)
    return same


def align_block(block: int, doc_ids: list, texts: list[str], tables: Vocabularies) -> Iterator[pa.RecordBatch]:
    """A row per document with its links as places in the block's pairs, and a row with the pairs and their counts."""
    ids, good, digests, links, seen = tables.encode(texts), [], [""] * len(texts), [], 0
    sizes = {"n_a": [], "n_b": [], "n_groups": [], "n_links": []}
    for part in parts_of(texts, ALIGNED_CHARS):
        rows = np.arange(seen, seen + len(part))
        seen += len(part)
        mine = [side.take(pa.array(rows)) for side in ids]
        kept = np.flatnonzero(spelled(part, mine, tables))
        mine = [side.take(pa.array(kept)) for side in mine]
        found = align(mine, tables)
        for n, text in zip(rows[kept], found["groups"]):
            digests[n] = hashlib.sha256(text.as_buffer()).hexdigest()
        good.append(rows[kept])
        links.append(found["links"])
        for name, values in zip(sizes, (pc.list_value_length(mine[0]), pc.list_value_length(mine[1]), found["n_groups"], found["n_links"])):
            sizes[name].append(values.to_numpy())
        del found, mine
    good, links = np.concatenate([np.zeros(0, np.int64), *good]), pa.concat_arrays([pa.array([], pa.int64()), *links])

    def every(name: str) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        out[good] = np.concatenate([np.zeros(0, np.int64), *sizes[name]])
        return pa.array(out)

    counts = pa.table({"pair": links}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pairs = counts["pair"].combine_chunks()
    links = pc.cast(pc.index_in(links, value_set=pairs), pa.int32())
    n_links = every("n_links")
    lists = pa.ListArray.from_arrays(pc.cast(_offsets(n_links), pa.int32()), links)
    n = len(texts)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, block)), pa.array(doc_ids, pa.int64()), every("n_a"), every("n_b"), every("n_groups"), n_links, pa.array(digests), lists,
        pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
    ], schema=_ROWS)
    if len(pairs):
        yield pa.RecordBatch.from_pylist([{"block": block}], schema=_ROWS).set_column(
            8, "pairs", pa.ListArray.from_arrays([0, len(pairs)], pairs)
        ).set_column(9, "counts", pa.ListArray.from_arrays([0, len(pairs)], counts["count_all"].combine_chunks()))


def with_counts(key: tuple, documents: pa.Table, scored: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents, from the corpus-wide count of each of the block's pairs."""
    total, best = np.zeros(scored.num_rows, np.int64), np.zeros(scored.num_rows, np.int64)
    places = scored["place"].to_numpy()
    total[places], best[places] = scored["total"].to_numpy(), scored["is_best"].to_numpy()
    lists = documents["links"].combine_chunks()
    document, links = pc.list_parent_indices(lists), pc.list_flatten(lists)
    sums = pa.table({"document": document, "total": pa.array(total).take(links), "best": pa.array(best).take(links)})
    sums = sums.group_by("document", use_threads=False).aggregate([("total", "sum"), ("best", "sum")])
    out = np.zeros((2, documents.num_rows), np.int64)
    out[:, sums["document"].to_numpy()] = sums["best_sum"].to_numpy(), sums["total_sum"].to_numpy()
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(out[0])).append_column("count_sum", pa.array(out[1]))
    return kept.append_column("groups_sha256", documents["groups_sha256"])


def aligned_blocks(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Stored rows of all blocks: documents with their links, and one row of pairs with counts per block."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, first, number = vocabularies(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        doc_ids, texts, held = [], [], 0
        for batch in rows:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= block_chars:
                    yield from align_block(first + number, doc_ids, texts, tables)
                    doc_ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield from align_block(first + number, doc_ids, texts, tables)

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(source.mapInArrow(batches, _STORED), "aligned")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """`of_block`, `place`, `pair`, `n`: the partial counts."""
    zipped = blocks.where(F.col("pairs").isNotNull()).select(F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    return zipped.select("of_block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(partial: DataFrame) -> DataFrame:
    """Corpus-wide links of each pair of ids: `a`, `b`, `total`, and whether no other pair of that b has more."""
    totals = partial.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(2**_SHIFT - 1))
    totals = materialize(totals, "pair-counts")
    tops = totals.groupBy("b").agg(F.max("total").alias("top"))  # a row per id of B
    out = totals.join(F.broadcast(tops), "b")
    return out.select("pair", F.shiftright("pair", _SHIFT).alias("a"), "b", "total", (F.col("total") == F.col("top")).alias("is_best"))


def align_tokenizers(
    df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Counts of tokens, groups and links per document, how many links are the best of their B id, and the digest of the groups."""
    blocks = aligned_blocks(df, path_a, path_b, id_col, text, block_chars)
    partial = block_pairs(blocks)
    scored = partial.drop("n").join(pair_counts(partial).drop("a", "b"), "pair").select("of_block", "place", "total", "is_best")
    documents = blocks.where(F.col("links").isNotNull()).drop("pairs", "counts")
    return documents.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(
        with_counts,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
