"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words in lower case; two lines are near if one word edit (a changed, missing or added word) makes
them equal. Every line emits a hashed key for each variant with one word deleted; a changed word shows as
equal variants with the same place deleted, a missing word as a variant equal to a whole line. Words are
compared again before a link counts. A line goes if an equal or near line occurs earlier, in the order of
(document id, line number); that earliest one is its keeper.

Equal lines are one class, of which only the first occurrence takes part in the join. Before variants are
made, a lossless sieve keeps lines that could have a partner: of two near lines, one edit leaves either the
first or the last q words equal, for a q that follows from their lengths. Groups of equal variants are only
ever reduced to their earliest line, so no pairs are made within a group, however large.

Defined results: null and empty texts have no lines; lines of fewer than `least_words` words are left alone;
null ids come first. Rows that share an id, or have none, are documents of their own as long as their texts differ, in the order
of their texts' hashes; rows equal in id and text count as one document. An empty table gives no duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from residua.llm.row_keys import NUMBER, ids_are_unique, text_numbers, with_numbers
from residua.operators.storage import materialize

LEAST_WORDS = 5
BLOCK = 256
#: Rows of a table that may be broadcast: below 16 MB at the widths used here.
BROADCAST_ROWS = 400_000


def _joined(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Broadcast join if the small side has few rows, else a shuffled one."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, list(on), how)


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[ \t-\r]+"), "")


def _split(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.lower(F.col(text)), "\n")).alias("line_no", "line"))


def lines_of(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """`doc_id`, `line_no` (from 0), `words`, and the class key `k1`, `k2` of every line with enough words."""
    lines = _split(df, id_col, text).withColumn("words", words_of(F.col("line"))).drop("line")
    lines = lines.where(F.size("words") >= least_words)
    return lines.withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit("second"), "words")})


def sieve_keys(words: Column) -> Column:
    """Hashes of the first and last q words, for the q of this length and of one word less."""
    n = F.size(words)

    def reach(length: Column) -> Column:  # the largest power of two of which two fit into length - 1
        return F.pow(F.lit(2), F.length(F.bin(F.greatest(F.floor((length - 1) / 2), F.lit(1)).cast("bigint"))) - 1).cast("int")

    def pair(q: Column) -> Column:
        return F.array(F.xxhash64(F.lit("P"), q, F.slice(words, F.lit(1), q)), F.xxhash64(F.lit("S"), q, F.slice(words, n - q + 1, q)))

    far, near = reach(n), reach(n - 1)
    return F.when(far == near, pair(far)).otherwise(F.concat(pair(far), pair(near)))


def with_running_xor(df: DataFrame, column: str, out: str) -> DataFrame:
    """Running xor of an array of longs. Arrays grow by copies, so this goes by blocks, then over the blocks."""
    grow = lambda a: F.aggregate(a, F.array(F.lit(0).cast("bigint")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1).bitwiseXOR(x))))
    starts = F.sequence(F.lit(0), F.floor((F.size(column) - 1) / BLOCK).cast("int"))
    df = df.withColumn("__inner", F.transform(starts, lambda b: grow(F.slice(column, b * BLOCK + 1, F.lit(BLOCK)))))
    df = df.withColumn("__before", grow(F.transform("__inner", lambda a: F.element_at(a, -1))))
    after = F.transform("__inner", lambda a, b: F.transform(F.slice(a, F.lit(2), F.size(a) - 1), lambda x: x.bitwiseXOR(F.get("__before", b))))
    return df.withColumn(out, F.flatten(after)).drop("__inner", "__before")


def with_variants(df: DataFrame) -> DataFrame:
    """`variants` (key of the words without the i-th, in order) and `whole` (key of all words).

    A key is the xor of the hashes of (word, place) and of the number of words; behind a deleted word the
    places are one less.
    """
    df = df.withColumns({
        "__here": F.transform("words", lambda w, i: F.xxhash64(w, i)), "__less": F.transform("words", lambda w, i: F.xxhash64(w, i - 1)),
    })
    df = with_running_xor(with_running_xor(df, "__here", "__upto"), "__less", "__upto_less")
    df = df.withColumns({
        "__rest": F.element_at("__upto_less", -1).bitwiseXOR(F.xxhash64(F.size("words") - 1)),
        "whole": F.element_at("__upto", -1).bitwiseXOR(F.xxhash64(F.size("words"))),
    })
    zero = F.lit(0).cast("bigint")
    variants = F.transform("__upto_less", lambda x, i: x.bitwiseXOR(F.col("__rest")).bitwiseXOR(F.when(i > 0, F.get("__upto", i - 1)).otherwise(zero)))
    return df.withColumn("variants", variants).drop("__here", "__less", "__upto", "__upto_less", "__rest")


def one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word edit makes two lists of words equal."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    shorter, longer = F.when(F.size(a) < F.size(b), a).otherwise(b), F.when(F.size(a) < F.size(b), b).otherwise(a)
    at = F.array_position(F.zip_with(shorter, longer, lambda x, y: x.eqNullSafe(y)), False).cast("int")  # always found: the lengths differ
    spared = F.concat(F.slice(longer, F.lit(1), at - 1), F.slice(longer, at + 1, F.size(longer)))
    return F.when(F.size(a) == F.size(b), same <= 1).when(F.abs(F.size(a) - F.size(b)) == 1, spared == shorter).otherwise(False)


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """`doc_id`, `line_no`, `keeper_doc_id`, `keeper_line_no`, `edits` (0 or 1) of every line that goes."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    if ids_are_unique(df, "doc_id"):
        return _duplicates(df, "doc_id", "text", least_words)
    numbers = text_numbers(df, "doc_id", "text")
    found = _duplicates(with_numbers(df, numbers, "doc_id", "text"), NUMBER, "text", least_words)
    ids = numbers.select(F.col("__id").alias("doc_id"), NUMBER)
    keepers = ids.select(F.col("doc_id").alias("keeper"), F.col(NUMBER).alias("keeper_doc_id"))
    named = found.withColumnRenamed("doc_id", NUMBER).join(ids, NUMBER).join(keepers, "keeper_doc_id")
    return named.select("doc_id", "line_no", F.col("keeper").alias("keeper_doc_id"), "keeper_line_no", "edits")


def _duplicates(df: DataFrame, id_col: str, text: str, least_words: int) -> DataFrame:
    """`duplicate_lines` of documents that an id or number tells apart."""
    lines = lines_of(df, id_col, text, least_words)
    stored = materialize(lines.select("doc_id", "line_no", "k1", "k2", sieve_keys(F.col("words")).alias("sieve")), "lines")
    classes = stored.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select("k1", "k2", "n", "first.doc_id", "first.line_no"), "classes")

    sieved = stored.select("k1", "k2", F.explode("sieve").alias("key"))
    # Stored, so that both sides of the join are shuffled for it and a hot key can be split.
    met = materialize(sieved.groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("key"), "met")
    hopeful = sieved.join(met, "key", "left_semi").select("k1", "k2").distinct()
    firsts = classes.join(hopeful, ["k1", "k2"], "left_semi").select("k1", "k2", "doc_id", "line_no")
    # Numbers that follow the order of first occurrence; stored, so that they stay what they are.
    places = [F.col("doc_id").asc_nulls_first(), F.col("line_no")]
    numbered = materialize(
        firsts.repartitionByRange(*places).sortWithinPartitions(*places).withColumn("number", F.monotonically_increasing_id()), "numbers"
    )
    candidates = _candidates(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), numbered)

    variants = candidates.select("number", F.posexplode("variants").alias("place", "key"))
    groups = variants.groupBy("key", "place").agg(F.min("number").alias("early"), F.max("number").alias("late")).where("early < late").drop("late")
    changed = _joined(variants, materialize(groups, "groups"), ["key", "place"]).where("early < number").select("number", "early")
    wholes = candidates.select(F.col("whole").alias("key"), F.col("number").alias("other"))
    missing = _joined(variants, wholes, ["key"]).where("number <> other").select(
        F.greatest("number", "other").alias("number"), F.least("number", "other").alias("early")
    )
    links = changed.union(missing).distinct()
    left = candidates.select("number", F.col("words").alias("words_late"))
    right = candidates.select(F.col("number").alias("early"), F.col("words").alias("words_early"))
    near = links.join(left, "number").join(right, "early").where(one_edit(F.col("words_late"), F.col("words_early")))
    near = near.groupBy("number").agg(F.min("early").alias("early"))
    keepers = numbered.select(F.col("number").alias("early"), F.struct("doc_id", "line_no").alias("near"))
    near = near.join(keepers, "early").join(numbered.select("number", "k1", "k2"), "number").select("k1", "k2", "near")

    judged = classes.join(near, ["k1", "k2"], "left").where("n > 1 or near is not null")
    own = F.struct("doc_id", "line_no")
    judged = judged.select(
        "k1", "k2", F.coalesce(F.col("near"), own).alias("keeper"), F.when(F.col("near").isNotNull(), 1).otherwise(0).alias("edits")
    )
    gone = stored.select("doc_id", "line_no", "k1", "k2").join(judged, ["k1", "k2"])
    gone = gone.where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("keeper")))
    return gone.select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("keeper.doc_id").alias("keeper_doc_id"),
        F.col("keeper.line_no").cast("bigint").alias("keeper_line_no"), F.col("edits").cast("bigint").alias("edits"),
    )


def _candidates(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Words, variants and whole key of the numbered lines, read from the texts again."""
    wanted = numbered.select("number", "k1", F.col("doc_id").alias("__doc"), F.col("line_no").alias("__line"))
    few = wanted.count() <= BROADCAST_ROWS
    if few:  # only their texts are taken apart
        ids = wanted.select("__doc").distinct()
        docs = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["__doc"]), "left_semi")
    split = _split(docs, "doc_id", "text")
    here = split["doc_id"].eqNullSafe(wanted["__doc"]) & (split["line_no"] == wanted["__line"])
    found = split.join(F.broadcast(wanted) if few else wanted, here).select("number", "k1", words_of(F.col("line")).alias("words"))
    found = found.where(F.xxhash64("words") == F.col("k1")).drop("k1")  # rows that repeat an id may differ
    return materialize(with_variants(found), "candidates")


def without_duplicate_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """`df` with the duplicate lines cut from its texts; all columns stay."""
    columns, key = df.columns, id_col
    if not ids_are_unique(df, id_col):
        df, key = with_numbers(df, text_numbers(df, id_col, text), id_col, text), NUMBER
    gone = materialize(_duplicates(df, key, text, least_words), "gone").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line_no").alias("__gone"))
    joined = df.join(gone, df[key].eqNullSafe(gone["__doc"]), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("__gone", i.cast("bigint")))
    cut = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text, cut).select(*columns)
