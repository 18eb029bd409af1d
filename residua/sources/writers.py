"""Exports: CSV, FASTA and named table sets. Every task writes its own part files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from residua.functions.sequences import clean_sequence


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_fasta(df: DataFrame, path: str, name_col: str = "Name", sequence_col: str = "Sequence", mode: str = "errorifexists") -> None:
    """Two lines per row: header and cleaned sequence."""
    name = F.coalesce(F.col(f"`{name_col}`").cast("string"), F.lit(""))
    record = F.concat(F.lit(">"), name, F.lit("\n"), clean_sequence(F.col(f"`{sequence_col}`")))
    df.select(record.alias("value")).write.mode(mode).text(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> list[str]:
    """One Parquet table per name under a common folder."""
    written = []
    for name, table in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        table.write.mode(mode).parquet(target)
        written.append(target)
    return written
