"""The subword classifier: rows against a plain count, gradients against differences, held-out accuracy, odd input."""

import collections
import random
from zlib import crc32

import numpy as np
import pytest

from residua.llm import subwords
from tests.llm.conftest import odd_rows, prose

JUNK = ["{}$$$", "{}%%%", "| {} |", "{}###"]


def plain_rows(text):
    """Counts of rows, word by word and n-gram by n-gram."""
    counts, before = collections.Counter(), None
    for word in (text or "").split():
        spelled = subwords.spelling([word])
        counts[int(subwords._row(spelled, 2)[0])] += 1
        letters = [ord(c) for c in f"\x02{word}\x03"]
        for n in subwords.GRAMS:
            for i in range(len(letters) - n + 1):
                key = 0
                for c in letters[i:i + n]:
                    key = (key * int(subwords._ODD[7]) + c) % 2**64
                counts[int(subwords._row(np.array([key], np.uint64), 3 + n - subwords.GRAMS[0])[0])] += 1
        if before is not None:
            counts[int(subwords.pair_rows(np.concatenate([before, spelled]))[0])] += 1
        before = spelled
    return counts


def corpus():
    rows, chance = [], random.Random(4)
    for i in range(400):
        text = prose(i + 2000, 20 + i % 60)
        if i % 4 == 0:
            text = " ".join(chance.choice(JUNK).format(w) for w in text.split())
        if i % 40 == 6:
            text = " ".join([f"word{i}"] * 60)
        rows.append((i, text, int(i % 4 != 0 and i % 40 != 6)))
    return rows


@pytest.mark.parametrize("text", [prose(1, 40), "a a a b", "日本語 Ünïcödé 😀", "x", "y" * 300, "  ", "", None])
def test_rows_of_a_text_equal_a_plain_count(text):
    rows, shares = subwords.text_rows(text)
    counts = plain_rows(text)
    total = sum(counts.values())
    assert dict(zip(rows.tolist(), shares.tolist())) == pytest.approx({r: n / total for r, n in counts.items()})


def test_neighbouring_repeats_share_a_row_whatever_the_word():
    pair = lambda a, b: int(subwords.pair_rows(subwords.spelling([a, b]))[0])
    assert pair("one", "one") == pair("zwei", "zwei") != pair("one", "zwei") != pair("zwei", "one")


def test_scores_are_those_of_the_mean_vector(monkeypatch):
    texts = [r[1] for r in corpus()[:60]] + [t for _, t, *_ in odd_rows()]
    found = [subwords.text_rows(t) for t in texts]
    model = subwords.train(found, np.array([n % 3 > 0 for n in range(len(texts))], np.int64), epochs=2)
    expected = []
    for rows, shares in found:
        z = (shares @ model.table[rows] if len(rows) else np.zeros(subwords.DIMENSIONS)) @ model.layer + model.bias
        expected.append(z[1] - z[0])
    monkeypatch.setattr(subwords, "REMEMBERED_WORDS", 50)  # forgotten again and again
    scorer = subwords.Scorer(model)
    got = np.concatenate([scorer.logits([t or "" for t in texts[i:i + 7]]) for i in range(0, len(texts), 7)])
    assert np.allclose(got, expected, atol=1e-4)
    assert max(map(len, scorer.known)) <= subwords.LONGEST_REMEMBERED


def test_a_step_follows_the_gradient():
    rows, shares = subwords.text_rows(prose(3, 12))
    other = subwords.text_rows("zzz")
    start = subwords.train([(rows, shares), other], np.array([1, 0]), epochs=1)
    loss = lambda table: -np.log(subwords.softmax((shares @ table[rows]) @ start.layer + start.bias)[0])
    z = subwords.softmax((shares @ start.table[rows]) @ start.layer + start.bias)
    gradient = start.layer @ (z - np.array([1, 0]))  # of the mean vector, for label 0
    for place in (0, len(rows) // 2):
        for d in (0, subwords.DIMENSIONS - 1):
            moved = start.table.astype(np.float64)
            moved[rows[place], d] += 1e-3
            assert (loss(moved) - loss(start.table.astype(np.float64))) / 1e-3 == pytest.approx(gradient[d] * shares[place], rel=0.05, abs=1e-6)


def test_held_out_rows_are_judged_rightly(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0.5) for i, _, q in rows] + [(None, 1, 0.1), (7, None, 0.1), (9999, 0, 0.1)], "doc_id long, quality int, text double")
    got = {r.doc_id: r for r in subwords.classify(docs, labels).collect()}
    assert len(got) == 400 and all(r.held_out == (crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95

    learned = [(i, q) for i, _, q in rows if crc32(str(i).encode()) % 4 != 2]
    flipped = spark.createDataFrame([(i, q if (i, q) in set(learned) else 1 - q, 0.5) for i, _, q in rows], labels.schema)
    again = {r.doc_id: r.score for r in subwords.classify(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}  # labels of held-out rows change nothing


def test_subwords_on_odd_and_no_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)] * 2, "doc_id long, quality int")
    got = subwords.classify(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    by_text = collections.defaultdict(set)
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            by_text[" ".join((texts[r.doc_id] or "").split())].add(r.score)
    assert all(len(scores) == 1 for scores in by_text.values())
    assert subwords.classify(none, labels).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in subwords.classify(odd, no_labels).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 15)], "doc_id long, quality int")
    assert all(r.score > 0.8 for r in subwords.classify(odd, ones).collect())
