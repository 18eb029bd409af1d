import pytest

WORDS = "the of and to in is that for with from river stone light paper window garden letter winter summer bridge".split()
ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long, "
    "a long, b long, n int, first string, number long, words array<string>, starts array<int>"
)


def prose(seed: int, n: int) -> str:
    """Reproducible words."""
    out, state = [], seed * 7919 + 13
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        word = WORDS[(state >> 8) % len(WORDS)]
        out.append(word + str((state >> 16) % 97) if (state >> 4) % 3 else word)
        if i % 17 == 16:
            out[-1] += "."
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and ids."""
    long_line, lines = prose(1, 6000), "\n".join(prose(i, 9) for i in range(400))
    texts = [
        (1, prose(2, 120)), (2, prose(2, 120)), (3, prose(2, 120) + " end"), (4, None), (5, ""), (6, " \t\n "), (7, "one"),
        (8, long_line), (9, lines), (9, lines), (10, "\n".join([prose(3, 8)] * 5)), (11, prose(4, 90).upper()), (12, "a" * 1500),
        (None, prose(5, 60)), (None, None), (13, prose(2, 60) + "\n\n" + prose(6, 60)), (14, "日本語 Ünïcödé 😀 <|endoftext|> x"), (-5, prose(7, 70)),
    ]
    langs = ["en", None, "xx", "de"]
    return [(i, t, langs[k % 4], None, None, 0.5, True, 1, 2, 3, 4, "f", 5, ["w"], [1]) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
