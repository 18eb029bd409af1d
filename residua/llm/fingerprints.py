"""Merkle fingerprints of documents, in DataFrame functions only.

A text is cut, without losing a character, into sections (a blank line starts one), paragraphs (lines) and
clauses (up to a run of stops, at most 160 characters). Clauses are hashed; a paragraph's node hashes its
clauses, a section's node its paragraphs, the root its sections. Equal roots mean equal texts; where roots
differ, the nodes that differ show the section, paragraph and clause of the edit.

The fingerprint is `root:` and the short clause digests, paragraphs apart by `.` and sections by `/`.
Likeness is 1 for equal roots, else the Dice share of distinct clause digests, below 1.

Defined results: a null text counts as empty, whose root hashes no sections; two empty texts are alike (1.0).
Null ids come first; rows that share an id follow each other in the order of their texts, and each is kept.
A single document is its own successor; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

SECTION_CUT, PARAGRAPH_CUT = r"(?<=\n)(?=[ \t]*\n)", r"(?<=\n)"
CLAUSE = r"([^.!?,;|]{0,159}[.!?,;|]+[ \t-\r]*|[^.!?,;|]{1,160})"
SHORT = 12
ROWS_PER_RANGE, MOST_RANGES = 2048, 20_000


def tree(text: Column) -> Column:
    """Clause digests by section and paragraph: array<array<array<string>>>."""
    pieces = lambda t, cut: F.filter(F.split(t, cut), lambda x: x != "")
    clauses = lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(1)), lambda c: F.sha2(c, 256))
    return F.transform(pieces(text, SECTION_CUT), lambda s: F.transform(pieces(s, PARAGRAPH_CUT), clauses))


def paragraph_nodes(clauses: Column) -> Column:
    return F.transform(clauses, lambda s: F.transform(s, lambda p: F.sha2(F.concat(F.lit("P"), F.array_join(p, "")), 256)))


def section_nodes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.concat(F.lit("S"), F.array_join(s, "")), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("R"), F.array_join(sections, "")), 256)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out` (the fingerprint) and `<out>_leaves` (its distinct short clause digests)."""
    df = df.withColumn("__tree", tree(F.coalesce(F.col(text), F.lit(""))))
    short = F.transform("__tree", lambda s: F.transform(s, lambda p: F.transform(p, lambda c: F.substring(c, 1, SHORT))))
    df = df.withColumns({"__root": root(section_nodes(paragraph_nodes(F.col("__tree")))), "__short": short})
    body = F.array_join(F.transform("__short", lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, "")), ".")), "/")
    return df.withColumns({
        out: F.concat("__root", F.lit(":"), body),
        f"{out}_leaves": F.array_distinct(F.flatten(F.flatten("__short"))),
    }).drop("__tree", "__root", "__short")


def likeness(a: str, b: str) -> Column:
    """Of two fingerprint columns made by `with_fingerprint`."""
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    x, y = F.col(f"{a}_leaves"), F.col(f"{b}_leaves")
    share = 2 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(same, F.lit(1.0)).otherwise(F.least(share.cast("double"), F.lit(0.999)))


def differing_branches(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sections and paragraphs (numbered from 0, by place) in which two text columns differ, one row each."""
    for side, text in (("__a", a), ("__b", b)):
        df = df.withColumn(f"{side}p", paragraph_nodes(tree(F.coalesce(F.col(text), F.lit("")))))
    empty = F.array().cast("array<string>")
    sections = F.sequence(F.lit(0), F.greatest(F.size("__ap"), F.size("__bp")) - 1)
    wide = df.withColumn("section", F.explode(F.when(F.greatest(F.size("__ap"), F.size("__bp")) > 0, sections)))
    wide = wide.withColumns({"__as": F.coalesce(F.get("__ap", "section"), empty), "__bs": F.coalesce(F.get("__bp", "section"), empty)})
    wide = wide.where(~F.col("__as").eqNullSafe(F.col("__bs")))
    paragraphs = F.sequence(F.lit(0), F.greatest(F.size("__as"), F.size("__bs")) - 1)
    wide = wide.withColumn("paragraph", F.explode(paragraphs))
    differ = ~F.get("__as", F.col("paragraph")).eqNullSafe(F.get("__bs", F.col("paragraph")))
    return wide.where(differ).drop("__ap", "__bp", "__as", "__bs")


def with_successor_rows(df: DataFrame, order: str, text: str) -> tuple[DataFrame, Window]:
    """Rows in ranges of `order`, and the window in which `lead` finds each row's successor, also across ranges.

    The ranges come from quantiles of the ids; the first row of each range is added, marked `__ghost`, to the
    range before it. One small row per range (at most `MOST_RANGES`) passes through the driver.
    """
    place = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    placed = df.withColumn("__place", place)
    ranges = min(MOST_RANGES, max(1, math.ceil(df.count() / ROWS_PER_RANGE)))
    inner = sorted(set(placed.approxQuantile("__place", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    cuts = [float("-inf"), *[c for c in inner if math.isfinite(c)], float("inf")]
    if len(cuts) > 2:
        placed = Bucketizer(splits=cuts, inputCol="__place", outputCol="__range").transform(placed)
    else:
        placed = placed.withColumn("__range", F.lit(0.0))
    placed = placed.withColumn("__range", F.col("__range").cast("int")).drop("__place")
    smallest = F.min(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("id")))["id"]
    firsts = sorted((r["__range"], r["first"]) for r in placed.select("__range", order).groupBy("__range").agg(smallest.alias("first")).collect())
    before = [(r, first, firsts[i - 1][0]) for i, (r, first) in enumerate(firsts)]
    if before:
        heads = df.sparkSession.createDataFrame(before, f"__head_range int, __first {dict(df.dtypes)[order]}, __before int")
        found = (placed["__range"] == heads["__head_range"]) & placed[order].eqNullSafe(heads["__first"])
        ghosts = placed.join(F.broadcast(heads), found).withColumn("__range", F.col("__before")).drop("__head_range", "__first", "__before")
        placed = placed.withColumn("__ghost", F.lit(False)).unionByName(ghosts.withColumn("__ghost", F.lit(True)))
    else:
        placed = placed.withColumn("__ghost", F.lit(False))
    return placed, Window.partitionBy("__range").orderBy("__ghost", F.col(order).asc_nulls_first(), F.col(text).asc_nulls_first())


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (second half replaced by the start of the next text)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, after = with_successor_rows(docs, "doc_id", "text")
    rows = rows.withColumn("__next", F.coalesce(F.lead("text").over(after), F.lit("")))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("__next", F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("__next")
    rows = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    ahead = {"following": F.lead("fingerprint").over(after), "following_leaves": F.lead("fingerprint_leaves").over(after)}
    return rows.withColumns(ahead).where(~F.col("__ghost")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "following").alias("near_next"),
    )
