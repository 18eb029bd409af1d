"""Quality rules by divergence from language references, in DataFrame functions only.

A document is described by two histograms: its characters by class and its words by a fixed list of
common words. The references are the same histograms summed over all documents of a language. A document
whose Jensen-Shannon distance from its language's reference is too large in either histogram is rejected.
Short texts have noisy histograms, so each comparison is made only from a minimum length on.

Defined results: a null text counts as empty, has no words and fails the base rules; a null or unlisted
language shares the reference of all such documents; a reference without any counts rejects nothing.
Repeated rows are judged one by one. Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from residua.operators.storage import materialize

# Common function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it",
    "de": "der die und das von zu mit sich des auf",
    "fr": "de la le et les des en un du que",
    "es": "de la que el en y a los del se",
}
WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
# Character classes, taken in this order; what is left is the last class.
CLASSES = {
    "lower": r"\p{Ll}+", "space": r"[ \t-\r]+", "upper": r"\p{Lu}+", "stop": r"[.,;:?!'()\-]+", "digit": r"\p{Nd}+",
}
SYMBOLS = "#*$%&|<>"

# A distance may reach `base + noise / sqrt(size)`: small histograms stray further from their reference.
CHAR_LIMIT, WORD_LIMIT = (0.14, 1.6), (0.15, 1.7)
MIN_CHARS, MIN_LETTER_WORDS = 200, 100


def with_repeated_words(df: DataFrame, words: str) -> DataFrame:
    """Add `n_repeat_words`: words standing in a window of three that occurs at least twice in the list.

    Most texts repeat no window; only the others have their windows sorted.
    """
    w, n = F.col(words), F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    df = df.withColumn("__windows", F.when(n >= 3, windows))
    ordered = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__ordered", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), ordered))
    df = df.withColumn("__last", F.size("__ordered") - 1)
    o, last = F.col("__ordered"), F.col("__last")
    is_same = lambda x, i: ((i > 0) & (F.get(o, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(o, i + 1)["h"] == x["h"]))
    df = df.withColumn("__same", F.filter(F.transform(o, lambda x, i: F.when(is_same(x, i), x["i"])), lambda i: i.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__same", lambda i: F.array(i, i + 1, i + 2)))))
    df = df.withColumn("n_repeat_words", F.when(F.col("__same").isNull(), F.lit(0)).otherwise(covered).cast("bigint"))
    return df.drop("__windows", "__ordered", "__last", "__same")


def described(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of the base rules and the histograms `__chars`, `__bins`; `__key` is a listed language or 'other'."""
    step = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    rest, left = F.col("__text"), [F.length("__text")]
    for k, pattern in enumerate(CLASSES.values()):
        step = step.withColumn(f"__rest{k}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"__rest{k}")
        left.append(F.length(rest))
    chars = [(a - b).cast("bigint") for a, b in zip(left, left[1:])] + [left[-1].cast("bigint")]
    no_blanks = left[0] - chars[list(CLASSES).index("space")]
    step = step.withColumns({
        "__words": F.array_remove(F.split("__text", r"[ \t-\r]+"), ""),
        "__lines": F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")),
        "__runs": F.btrim(F.regexp_replace(F.lower("__text"), r"\P{L}+", "|"), F.lit("|")),  # words of letters, by bars
        "__chars": F.array(*chars),
        "word_chars": no_blanks.cast("bigint"),
        # no symbol is a letter or blank, so the short rest has them all
        "n_symbols": (F.length("__rest2") - F.length(F.translate("__rest2", SYMBOLS, ""))).cast("bigint"),
    }).drop(*[f"__rest{k}" for k in range(len(CLASSES))], "__text")
    step = step.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__letter_words": F.when(F.col("__runs") == "", 0).otherwise(
            F.length("__runs") - F.length(F.replace("__runs", F.lit("|"), F.lit(""))) + 1
        ).cast("bigint"),
        "__short": F.regexp_replace(F.concat(F.lit("|"), F.replace("__runs", F.lit("|"), F.lit("||")), F.lit("|")), r"\|\p{L}{5,}(?=\|)", ""),
    })
    hits = [
        ((F.length("__short") - F.length(F.replace("__short", F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("bigint") for w in WORDS
    ]
    step = with_repeated_words(step.withColumn("__hits", F.array(*hits)), "__words")
    total = F.aggregate("__hits", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return step.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "__bins": F.concat("__hits", F.array(F.col("__letter_words") - total)),
        "__key": F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("other"),
    }).drop("__words", "__lines", "__runs", "__short", "__hits")


def with_distance(df: DataFrame, counts: str, reference: str, out: str) -> DataFrame:
    """Add the Jensen-Shannon distance (base 2, 0 to 1) of two histograms; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def term(p: Column, q: Column) -> Column:
        half = F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)
        return half / 2

    df = df.withColumns({"__n": total(F.col(counts)), "__m": total(F.col(reference))})
    df = df.withColumns({"__p": F.transform(counts, lambda x: x / F.col("__n")), "__q": F.transform(reference, lambda x: x / F.col("__m"))})
    apart = F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with("__p", "__q", term))))
    return df.withColumn(out, F.when((F.col("__n") > 0) & (F.col("__m") > 0), apart)).drop("__n", "__m", "__p", "__q")


def references(counted: DataFrame) -> DataFrame:
    """Summed histograms, one row per language key: at most the listed languages and 'other'."""
    def summed(column: str, bins: int) -> Column:
        return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(bins)])

    return counted.groupBy("__key").agg(
        summed("__chars", len(CLASSES) + 1).alias("__ref_chars"), summed("__bins", len(WORDS) + 1).alias("__ref_bins")
    )


def judge_quality(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT,
    min_chars: int = MIN_CHARS, min_letter_words: int = MIN_LETTER_WORDS,
) -> DataFrame:
    """Base counts, both distances and the verdict `kept`, one row per input row.

    The texts are read once; their counts are stored and then compared with the references made of them.
    The reference table has one row for each listed language and one for the rest, so it is broadcast.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = materialize(described(source).drop("text", "lang"), "quality")
    joined = counted.join(F.broadcast(references(counted)), "__key")
    judged = with_distance(with_distance(joined, "__chars", "__ref_chars", "char_distance"), "__bins", "__ref_bins", "word_distance")
    judged = judged.withColumn("__n_chars", F.aggregate("__chars", F.lit(0).cast("bigint"), lambda a, x: a + x))
    judged = judged.withColumns({
        "char_distance": F.when(F.col("__n_chars") >= min_chars, F.round("char_distance", 6)),
        "word_distance": F.when(F.col("__letter_words") >= min_letter_words, F.round("word_distance", 6)),
    })
    beyond = lambda d, size, limit: F.coalesce(F.col(d) > limit[0] + limit[1] / F.sqrt(size), F.lit(False))
    far = beyond("char_distance", "__n_chars", char_limit) | beyond("word_distance", "__letter_words", word_limit)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )
