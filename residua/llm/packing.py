"""Bounded-space online packing of documents into token sequences of a fixed length.

Each partition keeps a fixed number of windows open. A document's ids are cut at whole windows; what is left
goes to the open window it fits best. When none fits and no more may be opened, the fullest is emitted; if
that would leave a gap of over `most_gap` ids, the document's next ids fill it first. At the end of a
partition the emptiest open windows are moved, in cuts, into the others, so at most one stays unfilled;
these last windows of all partitions are merged whole, best fit first. Memory is `windows * size` ids.

Defined results: a null text counts as empty; every document ends in the separator id, so an empty one still
has one piece of one id. Rows that repeat a document id are packed as documents of their own. An empty table
gives no pieces. Which sequence a document meets depends on the partitions; its ids and pieces cover it exactly.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tiktoken import Encoding
from tokenizers import Tokenizer

from residua.llm.bpe import byte_letters
from residua.operators.storage import materialize

SIZE, WINDOWS, MOST_GAP, SEPARATOR = 4096, 64, 64, 2
#: Words remembered by a worker, at about 270 bytes each; more save time where workers have the memory.
REMEMBERED_WORDS, CHUNK_CHARS = 300_000, 1_000_000
#: The byte that stands for a word's end.
END = b"\x00"
_TOKENIZERS: dict[tuple[str, int], "WordIds"] = {}


def _latin_class(*categories: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in categories)


# The vocabulary's own word pattern, for texts of Latin-1 letters: letter runs, single digits, runs of the rest.
_LETTERS, _NUMBERS, _BLANKS = _latin_class("L"), _latin_class("N"), "\t\n\x0b\x0c\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+").findall


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Remembered:
    """A cache in two generations: what is asked for stays or moves to the young one; when that is full, the old one goes."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of `wanted` that are unknown; all others are in the young generation then."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        wanted = wanted.difference(self.young)
        found = wanted.intersection(self.old)
        for word in found:
            self.young[word] = self.old[word]
        return list(wanted - found)


class WordMerges:
    """The vocabulary's merges for whole words, many words in one call.

    A word's last letter is a symbol of its own in such vocabularies. Here it is the letter and the end mark after it, joined
    before all other merges; the other merges follow in the file's order, so the ids are the library's.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, suffix = byte_letters(), model["end_of_word_suffix"]

        def as_bytes(entry: str) -> bytes:
            ends = entry.endswith(suffix)
            body = entry[:-len(suffix)] if ends else entry
            return bytes(letters[c] for c in body) + END * ends

        ranks = {bytes([b]): b for b in range(256)}
        ids = {letters[entry]: i for entry, i in model["vocab"].items() if entry in letters}
        merged = [letter + suffix for letter in letters] + [
            "".join(merge.split(" ") if isinstance(merge, str) else merge) for merge in model["merges"]
        ]
        for entry in merged:
            if (content := as_bytes(entry)) not in ranks:
                ids[len(ranks)] = model["vocab"][entry]
                ranks[content] = len(ranks)
        self.ids = np.array([ids[n] for n in range(len(ranks))], "<u4")
        self.is_last = np.array([content.endswith(END) for content in ranks])
        self.encoding = Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each word; words hold no end mark."""
        if not words:
            return
        mark = END.decode()
        found = self.encoding.encode_to_numpy(mark.join(words) + mark, disallowed_special=())
        ids, ends = self.ids[found].tobytes(), 4 * (np.flatnonzero(self.is_last[found]) + 1)
        start = 0
        for end in ends.tolist():
            yield ids[start:end]
            start = end


class WordIds:
    """Ids of texts as the public library gives them; each distinct word is merged once while it is remembered.

    The vocabulary's normalizer and word pattern never look across words of Latin-1 texts, so a text's ids
    are those of its words; other texts, and texts with special tokens or the end mark, go to the library whole.
    """

    def __init__(self, path: str, remembered: int) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = [END.decode(), *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.merges = WordMerges(path)
        self.parts = Remembered(remembered)

    def _whole(self, text: str) -> bool:
        """Whether a text must be encoded in one piece."""
        return not is_latin(text) or any(s in text for s in self.apart)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if self._whole(t) else LATIN_WORDS(t.lower()) for t in texts]
        new = self.parts.missing(set().union(*(parts for parts in split if parts is not None)))
        known = self.parts.young
        known.update(zip(new, self.merges.encode(new)))
        return [
            b"".join(map(known.__getitem__, parts)) if parts is not None
            else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            for parts, text in zip(split, texts)
        ]


def word_ids(path: str, remembered: int = REMEMBERED_WORDS) -> WordIds:
    if (path, remembered) not in _TOKENIZERS:
        _TOKENIZERS[path, remembered] = WordIds(path, remembered)
    return _TOKENIZERS[path, remembered]


class Packer:
    """Open windows of one partition. A piece is (document row, start, ids as bytes)."""

    def __init__(self, size: int, windows: int, most_gap: int) -> None:
        self.size, self.windows, self.most_gap = size, windows, most_gap
        self.open: list[list] = []  # [space left, number, pieces]
        self.next_number = 0
        self.out: list[tuple] = []  # (document row, start, ids, window number, offset, whether the window is closed)

    def _new(self) -> list:
        window = [self.size, self.next_number, []]
        self.next_number += 1
        return window

    def _emit(self, window: list, closed: bool = True) -> None:
        offset = 0
        for row, start, ids in window[2]:
            self.out.append((row, start, ids, window[1], offset, closed))
            offset += len(ids) // 4

    def _put(self, window: list, piece: tuple) -> None:
        window[0] -= len(piece[2]) // 4
        window[2].append(piece)

    def add(self, row: tuple, ids: bytes) -> None:
        step, start = 4 * self.size, 0
        while len(ids) - 4 * start >= step:
            window = self._new()
            self._put(window, (row, start, ids[4 * start:4 * start + step]))
            self._emit(window)
            start += self.size
        while 4 * start < len(ids):
            length = len(ids) // 4 - start
            best = min((w for w in self.open if w[0] >= length), key=lambda w: (w[0], w[1]), default=None)
            if best is None and len(self.open) < self.windows:
                best = self._new()
                self.open.append(best)
            if best is None:
                best = min(self.open, key=lambda w: (w[0], w[1]))  # the fullest goes
                length = best[0] if best[0] > self.most_gap else 0
            if length:
                self._put(best, (row, start, ids[4 * start:4 * (start + length)]))
                start += length
            if not best[0] or not length:
                self.open.remove(best)
                self._emit(best)

    def finish(self) -> None:
        """Move the emptiest windows into the others; at most one stays unfilled and is left open."""
        self.open.sort(key=lambda w: (w[0], w[1]))
        while len(self.open) > 1:
            fullest, emptiest = self.open[0], self.open[-1]
            row, start, ids = emptiest[2].pop()
            keep = max(0, len(ids) // 4 - fullest[0])  # the end of the piece moves, its start stays
            if keep:
                emptiest[2].append((row, start, ids[:4 * keep]))
            self._put(fullest, (row, start + keep, ids[4 * keep:]))
            emptiest[0] += len(ids) // 4 - keep
            if not emptiest[2]:
                self.open.pop()
            if not fullest[0]:
                self._emit(self.open.pop(0))
        for window in self.open:
            self._emit(window, closed=not window[0])
        self.open = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, partition long, window long, "
    "offset long, closed boolean, ids binary"
)


def merge_last_windows(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Best-fit-decreasing merge of unfilled windows, one row each; gives each its sequence and offset."""
    spaces: list[list[int]] = []  # [space left, sequence]
    out = []
    for r in rows.sort_values(["filled", "partition"], ascending=[False, True]).itertuples():
        bin_ = min((b for b in spaces if b[0] >= r.filled), default=None)
        if bin_ is None:
            bin_ = [size, (r.partition << 32) + r.window]
            spaces.append(bin_)
        out.append((r.partition, r.window, bin_[1], size - bin_[0]))
        bin_[0] -= r.filled
    return pd.DataFrame(out, columns=["partition", "window", "sequence_id", "base"]).astype("int64")


def pack_documents(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE,
    windows: int = WINDOWS, most_gap: int = MOST_GAP, separator: int = SEPARATOR, with_ids: bool = False,
    remembered: int = REMEMBERED_WORDS,
) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; `with_ids` adds the ids as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = word_ids(vocabulary, remembered), Packer(size, windows, most_gap), struct.pack("<I", separator)
        partition = TaskContext.get().partitionId()

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            rows, starts, ids, numbers, offsets, closed = zip(*pieces)
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array(np.full(len(ids), partition), pa.int64()), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()),
                pa.array(closed, pa.bool_()), pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

        def chunks() -> Iterator[tuple[list, list[str]]]:
            for batch in batches:
                ids, texts, held = [], [], 0
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(doc_id)
                    texts.append(value.as_py() or "")
                    held += len(texts[-1])
                    if held > CHUNK_CHARS:
                        yield ids, texts
                        ids, texts, held = [], [], 0
                if ids:
                    yield ids, texts

        for doc_ids, texts in chunks():
            for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                packer.add((doc_id, len(ids) // 4 + 1), ids + end)
            if pieces := packer.taken():
                yield batch_of(pieces)
        packer.finish()
        if pieces := packer.taken():
            yield batch_of(pieces)

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(pack, PIECES), "pieces")
    last = pieces.where("not closed").groupBy("partition", "window").agg(F.sum("length").alias("filled"))
    merged = last.groupBy((F.col("partition") / 4096).cast("long").alias("many")).applyInPandas(
        lambda rows: merge_last_windows(rows, size), "partition long, window long, sequence_id long, base long"
    )
    out = pieces.join(merged, ["partition", "window"], "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("sequence_id", F.shiftleft("partition", 32) + F.col("window")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), "ids",
    )
    return out if with_ids else out.drop("ids")
