"""Cross-tokenizer alignment against overlaps counted byte by byte."""

import collections
import hashlib
import json
import random

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from residua.llm import alignment
from residua.llm.bpe import byte_letters
from tests.llm.conftest import ODD_SCHEMA, odd_rows, prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    "two  blanks\tand odd   ones", "▁ literal ▁ blocks", "<0x41> <s> </s> <unk> <|endoftext|> <|startoftext|>", "x" * 5000, " leading and trailing ",
    "\n\n\n", "é é ﬁ Ⅷ ½", "a\u0000b", "👩‍👩‍👧‍👦 🏳️‍🌈 अनुच्छेद ไทย العربية", "﻿mark", "end\r\n",
]


def test_words_have_the_ids_of_their_texts(monkeypatch):
    chance = random.Random(5)
    monkeypatch.setattr(alignment, "LONGEST_REMEMBERED", 20)
    tables = alignment.Vocabularies(*PATHS, remembered=30)
    pieces = ["a", "b c", "  ", " ", "\n", "\t ", "\u3000", "\xa0", "é", "1", "22", "...", "'s", "<|endoftext|>", "日本", "\r\n", "x" * 30, "\x1c", "\x85"]
    for n in range(300):
        texts = ["".join(chance.choice(pieces) for _ in range(chance.randrange(1, 12))) for _ in range(20)]
        for text, a, b in zip(texts, *tables.encode(texts)):
            assert a.as_py() == tables.a.encode(" " + text, add_special_tokens=False).ids and b.as_py() == tables.b.encode(text)
    assert tables.by_words and len(tables.known) < 600


def plain(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = byte_letters()
    with open(PATHS[0], encoding="utf-8") as file:
        content_a = {i: bytes(letters.get(c, 0) for c in s) for s, i in json.load(file)["model"]["vocab"].items()}
    content_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    documents = []
    for text in texts:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        content = [content_a[i] for i in ids[0]], [content_b(i) for i in ids[1]]
        if not text or any(b"".join(c) != (" " + text).encode() for c in content):
            documents.append(([], [], [], []))
            continue
        spans = []
        for side, pieces in zip(ids, content):
            spans.append([])
            at = 0
            for i, piece in zip(side, pieces):
                spans[-1].append((i, at, at + len(piece)))
                at += len(piece)
        links, start = [], 0
        for i, s, e in spans[0]:
            while start and spans[1][start][1] > s:
                start -= 1
            for j, t, f in spans[1][start:]:
                if t >= e:
                    break
                if max(s, t) < min(e, f):
                    links.append((i, j))
                    start = max(start, spans[1].index((j, t, f)))
        shared = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[i for i, s, e in side if before <= s and e <= end] for side in spans] for before, end in zip([0, *shared], shared)]
        documents.append((*ids, links, groups))
    counts = collections.Counter(x for d in documents for x in d[2])
    tops = collections.defaultdict(int)
    for (_, j), n in counts.items():
        tops[j] = max(tops[j], n)
    for ids_a, ids_b, links, groups in documents:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if ids_a else ""
        yield (
            len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == tops[x[1]] for x in links), sum(counts[x] for x in links), digest,
        )


def check(spark, rows, df, **options):
    expected = sorted(((r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]))), key=repr)
    got = sorted((tuple(r) for r in alignment.align_tokenizers(df, *PATHS, **options).collect()), key=repr)
    assert got == expected
    return got


def test_alignment_equals_overlaps_byte_by_byte(spark, odd):
    rows = [(r[0], None if r[1] is None else r[1][:4000]) for r in odd_rows()]
    assert check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_chars=700)


def test_alignment_of_odd_texts_in_one_and_many_blocks(spark):
    rows = [(i, t) for i, t in enumerate(MORE + [prose(k, 30) for k in range(5)])]
    df = spark.createDataFrame([(i, 1, t, 2, 3) for i, t in rows], "doc_id long, block int, text string, pair int, total int")
    many = check(spark, rows, df.repartition(4), block_chars=1)
    assert many == check(spark, rows, df.coalesce(1))
    assert any(r[1] == 0 and rows[r[0]][1] for r in many) and sum(r[1] > 0 for r in many) > 8


def test_alignment_of_long_and_no_texts(spark, odd, none):
    assert alignment.align_tokenizers(none, *PATHS).count() == 0
    got = alignment.align_tokenizers(odd, *PATHS).collect()
    assert len(got) == len(odd_rows())
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum for r in got)
    empty = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.align_tokenizers(empty, *PATHS).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_documents_of_a_block_are_aligned_a_few_at_a_time(monkeypatch):
    tables = alignment.vocabularies(*PATHS)
    texts = ["some words and more words", "", "a�é", "x " * 40, "one", "two three", "  odd"] * 5
    whole = [b.to_pylist() for b in alignment.align_block(3, list(range(len(texts))), texts, tables)]
    taken, plain = [], alignment.align
    monkeypatch.setattr(alignment, "ALIGNED_CHARS", 60)
    monkeypatch.setattr(alignment, "align", lambda ids, tables: taken.append(len(ids[0])) or plain(ids, tables))
    assert [b.to_pylist() for b in alignment.align_block(3, list(range(len(texts))), texts, tables)] == whole
    assert len(taken) > 5 and max(taken) < 8 and sum(r["n_links"] for r in whole[0]) == sum(whole[1][0]["counts"])
