"""Edit distances, matching places and changes of many sequences against one reference, a batch at a time.

The cells of an edit table differ from their neighbours by one at most, so a column of it is two bits a row, and one step along the
reference is a few operations on whole numbers. The columns of many sequences stand side by side in one long number, a
bit between each two that no carry passes, so the work is by the letters of the reference times the bits of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Letters that go side by side; a longer sequence goes by itself.
LETTERS_AT_ONCE = 1 << 16


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bits(number: int, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes((size + 7) // 8, "little"), np.uint8), count=size, bitorder="little")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def compared(reference: str, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance to the reference, and number of places with the same letter, of each sequence."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    codes, known = _codes("\0".join(sequences) + "\0"), _codes(reference)
    ends = np.cumsum(lengths + 1) - 1
    starts, size = ends - lengths, len(codes)
    inside = np.ones(size, bool)
    inside[ends] = False
    place = np.arange(size) - np.repeat(starts, lengths + 1)
    near = np.flatnonzero(inside & (place < len(known)))
    same = np.zeros(size, np.int64)
    same[near] = codes[near] == known[place[near]]
    first = np.zeros(size, bool)
    first[starts[lengths > 0]] = True
    body, border, heads = _number(inside), _number(~inside), _number(first)
    every = body | border
    letters = {c: _number(inside & (codes == ord(c))) for c in set(reference)}
    up, down = body, 0  # where a cell is one more, or one less, than the cell before it in its column
    for c in reference:
        equal = letters[c]
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        more = ((down | ((level | up | border) ^ every)) << 1) | heads
        less = ((up & level) << 1) & body
        up, down = less | ((vertical | more | border) ^ every), more & vertical
    steps = _bits(up, size).astype(np.int64) - _bits(down, size)
    return len(known) + np.add.reduceat(steps, starts), np.add.reduceat(same, starts)


def _parts(sequences: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive sequences of about `most` letters in all."""
    start = held = 0
    for n, sequence in enumerate(sequences):
        if n > start and held + len(sequence) >= most:
            yield start, n
            start, held = n, 0
        held += len(sequence) + 1
    if start < len(sequences):
        yield start, len(sequences)


def _compare(references: pa.Array, sequences: pa.Array) -> pa.Array:
    coded = references.dictionary_encode()
    which = coded.indices.fill_null(-1).to_numpy()
    good, out = (which >= 0) & sequences.is_valid().to_numpy(zero_copy_only=False), np.zeros((2, len(sequences)), np.int32)
    for n, reference in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(good & (which == n))
        texts = sequences.take(pa.array(rows)).to_pylist()
        for start, end in _parts(texts, LETTERS_AT_ONCE):
            out[:, rows[start:end]] = compared(reference, texts[start:end])
    return pa.StructArray.from_arrays([pa.array(values, mask=~good) for values in out], ["distance", "shared"])


def comparison(reference: Column, sequence: Column) -> Column:
    """`distance` and `shared` of a sequence and its reference; nulls where either is null."""
    return F.arrow_udf(_compare, "distance int, shared int")(reference, sequence)


def summaries(reference: str, sequences: list[str], limit: int | None = 12) -> list[str]:
    """Substitutions as `A3K`, then the length change; ` ...` when there are more than a given limit."""
    known, named = _codes(reference), [f"{residue}{place}" for place, residue in enumerate(reference, 1)]
    out = []
    for sequence in sequences:
        shorter, difference = min(len(sequence), len(reference)), len(sequence) - len(reference)
        places = np.flatnonzero(_codes(sequence[:shorter]) != known[:shorter])
        changes = [named[i] + sequence[i] for i in (places if limit is None else places[:limit + 1]).tolist()]
        if difference:
            changes.append(f"{difference:+d} residue(s)")
        more = limit is not None and len(changes) > limit
        out.append((", ".join(changes[:limit]) + " ...").lstrip() if more else ", ".join(changes) or "Reference")
    return out


def mutation_summary(reference: Column, sequence: Column, limit: int | None = 12) -> Column:
    """How each sequence differs from its reference; `Reference` where it does not, or where either is null."""

    def summarise(references: pa.Array, sequences: pa.Array) -> pa.Array:
        coded = references.dictionary_encode()
        which = coded.indices.fill_null(-1).to_numpy()
        texts, out = sequences.to_pylist(), ["Reference"] * len(sequences)
        for n, known in enumerate(coded.dictionary.to_pylist()):
            rows = [i for i in np.flatnonzero(which == n).tolist() if texts[i] is not None]
            for i, text in zip(rows, summaries(known, [texts[i] for i in rows], limit)):
                out[i] = text
        return pa.array(out, pa.string())

    return F.arrow_udf(summarise, "string")(reference, sequence)
