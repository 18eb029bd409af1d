"""Column expressions over sequence text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from residua.functions.constants import ALPHABET

_WHITESPACE = "(?U)[\\s\\x1c-\\x1f]+"
_NUMERAL = "^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf|infinity|Inf|Infinity)$"


def clean_sequence(sequence: Column) -> Column:
    """Upper case without any whitespace; missing becomes the empty string."""
    return F.upper(F.regexp_replace(F.coalesce(sequence.cast("string"), F.lit("")), _WHITESPACE, ""))


def has_residues(sequence: Column) -> Column:
    """Whether cleaning leaves anything, decided on the raw text.

    Unlike a test of the cleaned length this filter costs one look at the first characters when it
    is pushed below the cleaning.
    """
    return F.coalesce(sequence.cast("string"), F.lit("")).rlike("(?U)[^\\s\\x1c-\\x1f]")


def foreign_characters(cleaned: Column) -> Column:
    """What is left of a cleaned sequence after removing the standard residues."""
    return F.translate(cleaned, ALPHABET, "")


def is_standard(cleaned: Column) -> Column:
    return foreign_characters(cleaned) == ""


def is_peptide_like(cleaned: Column) -> Column:
    """At least three residues, all of them standard."""
    return (F.length(cleaned) >= 3) & is_standard(cleaned)


def invalid_characters(cleaned: Column) -> Column:
    """Distinct foreign characters, sorted, as one string."""
    letters = F.array_remove(F.split(foreign_characters(cleaned), ""), "")
    return F.array_join(F.array_sort(F.array_distinct(letters)), "")


def residues(cleaned: Column) -> Column:
    """Residues of a sequence as an array; the empty sequence has none."""
    return F.when(F.length(cleaned) > 0, F.split(cleaned, "")).otherwise(F.array().cast("array<string>"))


def to_number(value: Column, dtype: str = "string") -> Column:
    """Numeric value of a column, null where it does not parse (and null instead of NaN)."""
    if dtype in ("string", "char", "varchar"):
        text = F.trim(value)
        number = F.when(text.rlike(_NUMERAL), text.try_cast("double"))
    else:
        number = value.cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))
