"""Product codes against plain assignment in every round."""

import hashlib
import math

import numpy as np

from residua.llm import vector_codes as codes_of

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts array<int>, near int, __label string, error double"


def table(spark, rows, n=3):
    return spark.createDataFrame([(i, v, label, "x", [1], 2, "y", 0.5) for i, v, label in rows], SCHEMA).repartition(n)


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error), codebooks digest."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    most = int(2**28 / width**0.5)
    whole = [
        [max(-most, min(most, math.floor(4096 * float(np.float32(x))))) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept
    ]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, whole[n]))
    cut = lambda v, p: v[p * width:(p + 1) * width]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(whole[n], p) for n in order[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        best = [[min((square(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in whole]
        if turn == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, b in zip(whole, best) if b[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in b), e, by_label[label]) for (i, _, label), b, e in zip(kept, best, errors)], digest


def vectors(n, length=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.1, (9, length))
    return [(i, (centres[i % 9] + rng.normal(0, 0.03, length)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]


def same(spark, rows, **options):
    got = codes_of.compress(table(spark, rows), **options)
    report = codes_of.code_report(got).collect()
    expected, digest = plain(rows, **options)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in report), key=key) == sorted(expected, key=key)
    assert {r.codebooks_sha256 for r in report} <= {digest}
    return got


def test_codes_equal_plain_assignment(spark):
    got = same(spark, vectors(150))
    assert all(codes_of.LEAST_LISTED <= b <= codes_of.MOST_LISTED for b in got.listed)
    assert sum(d.sum() for d in got.depths) == 150 * 8 * 7 and all(d[0] for d in got.depths[3:])


def test_codes_of_odd_vectors(spark):
    good = vectors(20, 11, seed=3)
    odd = [
        (100, None, 1), (101, [None] + [0.1] * 10, 1), (102, [float("nan")] * 11, 1), (103, [float("inf")] * 11, 1), (104, [], 7), (105, [0.5], 7),
        (None, good[0][1], None), (None, good[1][1], None), (3, good[3][1], 2), (3, good[4][1], 2), (106, [3e38, -3e38] + [0.0] * 9, 9), (-9, [-0.00001] * 11, 9),
    ]
    same(spark, good + odd, rounds=3)
    same(spark, [(i, [0.25] * 16, 1) for i in range(30)], rounds=2)  # ties everywhere
    same(spark, vectors(5), rounds=2)  # fewer rows than entries
    same(spark, vectors(1), rounds=1)
    same(spark, [(1, [], None)], rounds=1)


def test_codes_of_no_vectors(spark):
    assert codes_of.code_report(codes_of.compress(table(spark, []))).count() == 0
    assert codes_of.code_report(codes_of.compress(table(spark, [(1, None, 1)]))).count() == 0


def test_bounds_hold_after_every_round():
    rng = np.random.default_rng(2)
    rows, book = rng.integers(-900, 900, (300, 5)), rng.integers(-900, 900, (12, 5))
    state = codes_of.Listing.empty(300, 4)
    state.search(rows, book)
    for listed in (4, 3, 5, 8, 2):
        new = book + rng.integers(-60, 60, book.shape)
        state.loosen(codes_of.ceil_root(((new - book) ** 2).sum(axis=1)))
        book = new
        state = state.resized(listed)
        state.update(rows, book)
        squares = codes_of.squares_to(rows, book)
        assert np.array_equal(state.near[:, 0], squares.argmin(axis=1))
        for row, near, bounds in zip(squares, state.near, state.bounds):
            assert row[near[0]] <= bounds[0] ** 2
            for z in range(1, listed):
                assert near[z] < 0 or row[near[z]] >= bounds[z] ** 2
            rest = [row[k] for k in range(len(book)) if k not in near]
            assert not rest or min(rest) >= bounds[-1] ** 2


def test_roots_are_exact():
    values = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**58 - 1, 2**58, (2**29 - 1) ** 2, (2**29 - 1) ** 2 - 1], np.int64)
    assert codes_of.floor_root(values).tolist() == [math.isqrt(int(v)) for v in values]
    assert codes_of.ceil_root(values).tolist() == [math.isqrt(int(v)) + (math.isqrt(int(v)) ** 2 < v) for v in values]
