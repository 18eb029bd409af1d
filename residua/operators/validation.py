"""Cleaning, three-way validation, duplicates and union of sequence tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions.naming import is_numeric_type, normalize_header, sequence_keys
from residua.functions.sequences import (
    clean_sequence,
    has_residues,
    invalid_characters,
    is_peptide_like,
    is_standard,
    to_number,
)
from residua.operators.ordering import with_row_number
from residua.operators.skew import semi_join_by_key
from residua.operators.storage import materialize

VALID, INVALID = "valid", "invalid"
_CONTENT_SHARE = 0.6


def tag_sequences(df: DataFrame, sequence_col: str = "Sequence") -> DataFrame:
    """Cleaned non-empty sequences with `status` and the `InvalidCharacters` of invalid ones."""
    seq = F.col(f"`{sequence_col}`")
    cleaned = df.filter(has_residues(seq)).withColumn(sequence_col, clean_sequence(seq))
    return cleaned.select(
        "*",
        F.when(is_standard(seq), VALID).otherwise(INVALID).alias("status"),
        F.when(~is_standard(seq), invalid_characters(seq)).alias("InvalidCharacters"),
    )


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key in the given order; combined map-side, so a hot key shuffles few rows."""
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])
    first = df.groupBy(F.col(f"`{key}`")).agg(F.min_by(packed, F.struct(*[F.col(f"`{c}`") for c in order])).alias("r"))
    return first.select(*[F.col(f"`{c}`") if c == key else F.col(f"r.`{c}`") for c in df.columns])


@dataclass(frozen=True)
class Validation:
    """Views over one tagged table: first valid rows, invalid rows, all rows of repeated sequences."""

    tagged: DataFrame
    sequence_col: str
    order: Sequence[str]

    @property
    def _valid_rows(self) -> DataFrame:
        return self.tagged.filter(F.col("status") == VALID).drop("status", "InvalidCharacters")

    @property
    def valid(self) -> DataFrame:
        return keep_first(self._valid_rows, self.sequence_col, self.order)

    @property
    def invalid(self) -> DataFrame:
        return self.tagged.filter(F.col("status") == INVALID).drop("status")

    @property
    def duplicates(self) -> DataFrame:
        rows = materialize(self._valid_rows, "valid")  # read for the counts and again for the rows
        return duplicate_rows(rows, self.sequence_col, self.order)

    @property
    def counts(self) -> DataFrame:
        """One row: unique valid sequences, invalid rows, rows of repeated valid sequences."""
        valid = F.col("status") == VALID
        per_key = self.tagged.groupBy("status", F.when(valid, F.col(f"`{self.sequence_col}`")).alias("k")).agg(
            F.count("*").alias("n")
        )
        return per_key.agg(
            F.count_if(valid).alias("valid_unique"),
            F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid_rows"),
            F.coalesce(F.sum(F.when(valid & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        )


def validate_sequences(df: DataFrame, sequence_col: str = "Sequence", order: Sequence[str] = ("row_id",)) -> Validation:
    return Validation(tag_sequences(df, sequence_col), sequence_col, tuple(order))


def duplicate_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Every row of a key that occurs more than once, sorted by key."""
    repeated = df.groupBy(key).agg(F.count("*").alias("__rows")).filter("__rows > 1")
    return semi_join_by_key(df, key, repeated, "__rows").orderBy(key, *order)


def union_sources(uploaded: DataFrame | None, manual: DataFrame | None, sequence_col: str | None = None) -> DataFrame:
    """Uploaded rows, then pasted rows, matched by column name; `source` keeps their order.

    The chosen sequence column of the uploaded table is renamed to `Sequence`.
    """
    frames = []
    if uploaded is not None:
        if sequence_col and sequence_col != "Sequence":
            uploaded = uploaded.withColumnRenamed(sequence_col, "Sequence")
        frames.append(uploaded.withColumn("source", F.lit(0)))
    if manual is not None:
        frames.append(manual.withColumn("source", F.lit(1)))
    if not frames:
        raise ValueError("No input table was given.")
    if len(frames) == 1:
        return frames[0]
    return frames[0].unionByName(frames[1], allowMissingColumns=True)


def guess_sequence_column(df: DataFrame) -> str | None:
    """Find the sequence column by known name, then by part of the name, then by content."""
    by_header = {normalize_header(c): c for c in df.columns}
    for key in sequence_keys():
        if key in by_header:
            return by_header[key]
    for c in df.columns:
        if "seq" in normalize_header(c) or "peptide" in normalize_header(c):
            return c
    if not df.columns:
        return None
    values = [F.col(f"`{c}`") for c in df.columns]
    like = [F.when(v.isNotNull(), is_peptide_like(clean_sequence(v)).cast("int")) for v in values]
    shares = df.agg(*[F.avg(v).alias(f"s{i}") for i, v in enumerate(like)]).first()  # all rows, all columns, one pass
    return next((c for i, c in enumerate(df.columns) if (shares[f"s{i}"] or 0.0) >= _CONTENT_SHARE), None)


def numeric_targets(df: DataFrame, descriptors: Sequence[str], minimum: int = 3) -> list[str]:
    """Columns other than descriptors, sequence and name with enough parseable numbers."""
    types = dict(df.dtypes)
    candidates = [c for c in df.columns if c not in descriptors and c.lower() not in ("sequence", "name")]
    candidates = [c for c in candidates if types[c] == "string" or is_numeric_type(types[c])]
    if not candidates:
        return []
    counts = df.agg(
        *[F.count(to_number(F.col(f"`{c}`"), types[c])).alias(f"n{i}") for i, c in enumerate(candidates)]
    ).first()
    return [c for i, c in enumerate(candidates) if counts[f"n{i}"] >= minimum]


def align_columns(df: DataFrame, keep: Sequence[str], required: Sequence[str], fill: float = 0.0) -> DataFrame:
    """The kept columns and all required ones as numbers; a required column that is absent is `fill`."""
    types = dict(df.dtypes)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[
            (to_number(F.col(f"`{c}`"), types[c]) if c in types else F.lit(fill)).alias(c)
            for c in required
        ],
    )


def with_default_names(df: DataFrame, order: Sequence[Column], prefix: str = "Peptide_") -> DataFrame:
    """Names `Peptide_1`, `Peptide_2`, ... in row order where the table has no names."""
    if "Name" in df.columns:
        return df
    numbered = with_row_number(df, order, "__n")
    return numbered.withColumn("Name", F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")


def class_count(df: DataFrame, target: str) -> DataFrame:
    """Number of distinct classes over the text of the present target values."""
    return df.agg(F.count_distinct(F.col(f"`{target}`").cast("string")).alias("classes"))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))


def parsed_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: present values and share of all rows that parse as a number."""
    types = dict(df.dtypes)
    stats = df.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"p{i}") for i, c in enumerate(columns)],
        *[
            F.avg(to_number(F.col(f"`{c}`"), types[c]).isNotNull().cast("int")).alias(f"r{i}")
            for i, c in enumerate(columns)
        ],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("present"), F.col(f"r{i}").alias("parsed_ratio")) for i, c in enumerate(columns)]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

