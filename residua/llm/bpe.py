"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's bytes are matched against an Aho-Corasick automaton of the whole vocabulary. The encoder takes the
longest token at each place, and keeps it only if it and the token before it would really stand side by side
after merging (the pair-compatibility table, filled as pairs occur); else it takes the next shorter prefix or
steps back. Each place is given up at most once, so the work is linear in the word. The result equals
merging by rank. Words repeat, so their codes are kept in a cache of bounded size per worker.

Defined results: a null text counts as empty and has no tokens; special tokens of the vocabulary are found in
the text as the public library finds them. Texts of any length are encoded whole; equal texts have equal codes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Fixed value: the public byte-level word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 600_000
_CODERS: dict[str, "Coder"] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coder:
    """A vocabulary file with the tables that encoding and decoding need."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocabulary = {as_bytes(s): i for s, i in stored["model"]["vocab"].items() if all(c in letters for c in s)}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        for content in self.special:
            vocabulary.pop(content.encode(), None)
        self.texts = {i: b for b, i in vocabulary.items()}
        # rank: when a token is made; single bytes are there from the start
        self.rank: dict[int, int] = {i: -1 for b, i in vocabulary.items() if len(b) == 1}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(stored["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocabulary[as_bytes(left)], vocabulary[as_bytes(right)]
            token = vocabulary[self.texts[a] + self.texts[b]]
            self.made.setdefault((a, b), token)
            if token not in self.parts:
                self.parts[token], self.rank[token] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for token, content in self.texts.items():
            if token in self.rank:
                self.automaton.add_word(content.decode("latin-1"), (len(content), token))
        self.automaton.make_automaton()
        self.shorter = self._prefixes()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, str]] = {}
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        size = 1 + max([*self.texts, *self.special.values()])
        pieces = [self.texts.get(i, b"") for i in range(size)]
        for content, i in self.special.items():
            pieces[i] = content.encode()
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def _prefixes(self) -> dict[int, int]:
        """The longest token that is a proper prefix of each token."""
        ids = {content: token for token, content in self.texts.items() if token in self.rank}
        found = {}
        for content, token in ids.items():
            for end in range(len(content) - 1, 0, -1):
                if (other := ids.get(content[:end])) is not None:
                    found[token] = other
                    break
        return found

    def _stand_together(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave token a directly before token b.

        Undoing the later merge of the two step by step, no pair met at the border may have been
        merged before the merge that was undone last.
        """
        rank, parts, made = self.rank, self.parts, self.made
        limit = 1 << 60
        while True:
            token = made.get((a, b))
            if token is not None and rank[token] < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = parts[a][1]
            else:
                if rank[b] < 0:
                    return True
                limit = rank[b] + 1  # at the same rank the pair further left is merged first
                b = parts[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        longest: list[int] = [-1] * n
        for end, (length, token) in self.automaton.iter(word.decode("latin-1")):
            longest[end - length + 1] = token  # later ends are longer
        if n and self.texts[longest[0]] == word:
            return [longest[0]]
        texts, shorter, compatible = self.texts, self.shorter, self.compatible
        out: list[int] = []
        place, dead = 0, bytearray(n + 1)
        token: int | None = longest[0] if n else None
        while place < n:
            while True:
                end = place + len(texts[token])
                if not dead[end]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    fits = compatible.get(pair)
                    if fits is None:
                        fits = compatible[pair] = self._stand_together(*pair)
                    if fits:
                        break
                token = shorter.get(token)
                if token is None:
                    break
            if token is not None:
                out.append(token)
                place = end
                token = longest[place] if place < n else None
            else:
                dead[place] = 1
                token = out.pop()  # its end is given up now, so a shorter one is tried
                place -= len(texts[token])
        return out

    def codes(self, words: list[str]) -> list[tuple[int, str]]:
        """(number of tokens, ids joined by commas) of each word."""
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        if len(self.compatible) > 4 * CACHED_WORDS:
            self.compatible.clear()
        out = []
        for word in words:
            code = known.get(word)
            if code is None:
                ids = self.encode_word(word.encode())
                code = known[word] = (len(ids), ",".join(map(str, ids)))
            out.append(code)
        return out

    def encode(self, text: str) -> tuple[int, str]:
        """(number of tokens, their ids in decimal joined by commas)."""
        count, parts = 0, []
        chunks = self.special_split(text) if any(content in text for content in self.special) else [text]
        for i, chunk in enumerate(chunks):
            if i % 2:
                count, _ = count + 1, parts.append(str(self.special[chunk]))
            elif chunk:
                codes = self.codes(self.split(chunk))
                count += sum(c[0] for c in codes)
                parts.extend(c[1] for c in codes)
        return count, ",".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids: their bytes are gathered by the offset table."""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[places].tobytes().decode("utf-8", errors="replace")


def coder(path: str) -> Coder:
    """The tables of a vocabulary file, made once per worker."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count, digest of the ids and digest of the text decoded from them, one row per input row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = coder(vocabulary)
        for batch in rows:
            counts, ids_digests, text_digests = [], [], []
            for value in batch.column(1):
                count, ids = tables.encode(value.as_py() or "")
                decoded = tables.decode(np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64))
                counts.append(count)
                ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
