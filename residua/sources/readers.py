"""Readers of sequence files: CSV, FASTA, SDF, delimited or plain text, and pasted text blocks.

Record files are read with the record mark as line separator, so a file of any size is split over
tasks at record borders. FASTA, SDF and list readers store what they read: the record number within
its file, on which "first" and default names depend, is fixed there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from residua.functions.naming import normalize_header_column, sequence_keys
from residua.functions.sequences import clean_sequence, is_peptide_like, to_number
from residua.operators.ordering import with_row_number
from residua.operators.storage import materialize

# Texts that mean a missing value in a delimited file.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
DELIMITERS = ("\t", ",", ";", "|")
NUMERIC_SHARE = 0.8
#: Names that become columns of a table; names of numeric properties that are broadcast.
MOST_COLUMNS, BROADCAST_KEYS = 2_000, 100_000

MEASUREMENT_SCHEMA = StructType(
    [StructField("Name", StringType()), StructField("Sequence", StringType())]
    + [StructField(c, DoubleType()) for c in ("Activity", "IC50")]
    + [StructField("ToxicityClass", StringType())]
    + [StructField(c, DoubleType()) for c in ("Solubility", "BindingScore")]
    + [StructField("ClassLabel", StringType()), StructField("DockingScore", DoubleType())]
)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",", quoted_line_ends: bool = False
) -> DataFrame:
    """Delimited table with a header. Without a schema, columns whose present values all parse become numbers.

    Files are split over tasks at line ends. Where quoted values hold line ends, say so: such files are read
    whole, one task each. Otherwise a row with an open quote stops the reading instead of giving broken rows.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", quoted_line_ends)
    if not quoted_line_ends:
        lines = spark.read.text(path)
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not lines.where((quotes % 2 == 1) & F.col("value").rlike(f'(^|{re.escape(sep)})"')).isEmpty():
            raise ValueError(f"Quoted values with line ends in {path}: read it with quoted_line_ends=True.")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return infer_numbers(reader.csv(path))


def infer_numbers(df: DataFrame) -> DataFrame:
    """Texts of missing values become null; columns left with numbers only become DOUBLE or BIGINT."""
    if not df.columns:
        return df
    present = {c: F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")) for c in df.columns}
    stats = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(present.values())],
        *[F.count(to_number(v)).alias(f"p{i}") for i, v in enumerate(present.values())],
        *[F.count_if(F.trim(v).rlike("^[+-]?\\d{1,18}$")).alias(f"w{i}") for i, v in enumerate(present.values())],
    ).first()
    columns = []
    for i, (c, v) in enumerate(present.items()):
        filled, numbers, whole = stats[f"n{i}"], stats[f"p{i}"], stats[f"w{i}"]
        if filled and numbers == filled:
            complete = whole == filled
            columns.append((F.trim(v).try_cast("bigint") if complete else to_number(v)).alias(c))
        else:
            columns.append(F.col(f"`{c}`") if not filled or c.lower() in sequence_keys() else v.alias(c))
    return df.select(*columns)


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Pieces of text between separators, with file and place, from one scan; `first` marks the start of a file.

    A task reads the pieces of a file in order, so the first piece of a file is the one before which the task
    read another file or none, if its block starts at 0.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            first = [block == 0 and file != last for file, block, last in zip(files, blocks, [before, *files])]
            before = files[-1] if files else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.bool_())], [*batch.schema.names, "first"])

    text = spark.read.option("lineSep", separator).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    marked = text.mapInArrow(mark, "value string, file string, block long, place long, first boolean")
    return marked.withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))


def _fasta_records(text: Column) -> Column:
    """Records of a FASTA text without the mark; what stands before the first header is dropped."""
    parts = F.split(F.concat(F.lit("\n"), text), "\n\\s*>")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _header(record: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(record, "\n", 1), "\\s+$", ""))


def _fasta_sequence(record: Column) -> Column:
    return F.when(record.contains("\n"), clean_sequence(F.regexp_replace(record, "^[^\n]*\n", ""))).otherwise("")


def _default_name(name: Column, prefix: str, number: Column) -> Column:
    return F.when(name != "", name).otherwise(F.concat(F.lit(prefix), number.cast("string")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, Name, Sequence); a record without a name is called `Sequence_<record>`."""
    chunks = _chunks(spark, path, "\n>")
    order = [F.col("block"), F.col("place"), F.col("part")]
    text = F.when(F.col("first"), F.col("value")).otherwise(F.concat(F.lit(">"), F.col("value")))
    records = chunks.select("file", "block", "place", F.posexplode(_fasta_records(text)).alias("part", "text"))
    named = records.select(
        "file", "block", "place", "part",
        _header(F.col("text")).alias("Name"), _fasta_sequence(F.col("text")).alias("Sequence"),
    )
    numbered = with_row_number(named, order, "record", ["file"])
    return numbered.select("file", "record", _default_name(F.col("Name"), "Sequence_", F.col("record")).alias("Name"), "Sequence")


def parse_sequence_blocks(df: DataFrame, text_col: str) -> DataFrame:
    """Pasted texts, one per row, to one row per sequence with its `record` number within the text.

    A text with FASTA records is read as such; any other is a list separated by line ends, commas,
    semicolons, tabs or blanks. Row-local: no shuffle.
    """
    keep = [c for c in df.columns if c != text_col]
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    fasta = _fasta_records(text)
    listed = F.transform(
        F.filter(
            F.transform(F.split(F.trim(text), "[\n,;\t ]+"), lambda t: F.upper(F.regexp_replace(t, "\\s+", ""))),
            lambda t: t != "",
        ),
        lambda t, i: F.struct(F.concat(F.lit("Manual_"), (i + 1).cast("string")).alias("Name"), t.alias("Sequence")),
    )
    named = F.transform(
        fasta,
        lambda r, i: F.struct(
            _default_name(_header(r), "Sequence_", i + 1).alias("Name"), _fasta_sequence(r).alias("Sequence")
        ),
    )
    rows = df.select(*keep, F.posexplode(F.when(F.size(fasta) > 0, named).otherwise(listed)).alias("__at", "r"))
    return rows.select(*keep, (F.col("__at") + 1).alias("record"), "r.Name", "r.Sequence")


def read_sequence_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, Name, Sequence) of a plain list of sequences; names are `Manual_<record>`."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    pieces = lines.select("file", "block", "place", F.posexplode(F.split("value", "[,;\t\r ]+")).alias("part", "text"))
    cleaned = pieces.withColumn("Sequence", clean_sequence(F.col("text"))).filter(F.col("Sequence") != "").drop("text")
    numbered = with_row_number(cleaned, [F.col("block"), F.col("place"), F.col("part")], "record", ["file"])
    return numbered.select("file", "record", F.concat(F.lit("Manual_"), F.col("record").cast("string")).alias("Name"), "Sequence")


_PROPERTY = "(?m)^[ \t]*>[ \t]*<([^>\n]+)>[ \t]*$\n?((?:[ \t]*\\S.*(?:\n|$))*)"


def read_sdf_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, Name, Sequence, properties): one row per molecule, properties in file order."""
    chunks = _chunks(spark, path, "$$$$").filter(F.col("value").rlike("\\S"))
    values = F.transform(
        F.regexp_extract_all("value", F.lit(_PROPERTY), F.lit(2)), lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, "\\s+$", "")), "[ \t]*\n[ \t]*", " ")
    )
    keys = F.transform(F.regexp_extract_all("value", F.lit(_PROPERTY), F.lit(1)), lambda k: F.trim(k))
    records = chunks.select(
        "file", "block", "place",
        F.trim(F.substring_index(F.regexp_replace("value", "^\\s+", ""), "\n", 1)).alias("title"),
        F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))).alias("properties"),
    )
    resolved = records.select(
        "file", "block", "place", "properties",
        F.coalesce(property_value(F.col("properties"), "Name"), F.col("title")).alias("Name"),
    )
    resolved = resolved.withColumn("Sequence", _sdf_sequence(F.col("properties"), F.col("Name")))
    numbered = with_row_number(resolved, [F.col("block"), F.col("place")], "record", ["file"])
    return numbered.select("file", "record", "Name", "Sequence", "properties")


def property_value(properties: Column, key: str) -> Column:
    """Value of a property; the last one where a molecule names it more than once."""
    return F.try_element_at(F.filter(properties, lambda p: p["key"] == key), F.lit(-1))["value"]


def _sdf_sequence(properties: Column, name: Column) -> Column:
    """A property with a known sequence name, else one that holds residues, else the title."""
    others = F.filter(properties, lambda p: p["key"] != "Name")
    known = F.filter(others, lambda p: normalize_header_column(p["key"]).isin(*sequence_keys()))
    residues = F.filter(
        F.transform(others, lambda p: clean_sequence(p["value"])), lambda s: is_peptide_like(s)
    )
    title = clean_sequence(name)
    return F.coalesce(
        property_value(properties, "Sequence"),
        clean_sequence_or_null(F.get(known, F.lit(0))["value"]),
        F.get(residues, F.lit(0)),
        F.when(is_peptide_like(title), title),
    )


def clean_sequence_or_null(value: Column) -> Column:
    return F.when(value.isNotNull(), clean_sequence(value))


def sdf_values(records: DataFrame) -> DataFrame:
    """(file, record, at, key, value): a row per property of a molecule, its last value where it is named more than once."""
    keys = F.transform("properties", lambda p: p["key"])
    last = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), property_value(F.col("properties"), k).alias("value")))
    single = F.when(F.size(F.array_distinct(keys)) == F.size("properties"), F.col("properties")).otherwise(last)
    rows = records.select("file", "record", F.posexplode(single).alias("at", "p"))
    return rows.select("file", "record", "at", F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def sdf_keys(records: DataFrame) -> DataFrame:
    """`key`, `present`, `is_numeric`, `first` of every property name, in one aggregate.

    Numeric is a property that parses as a number in at least 80 % of all molecules.
    """
    parsed = F.count_if(to_number(F.col("value")).isNotNull())
    found = sdf_values(records).groupBy("key").agg(F.count("value").alias("present"), parsed.alias("parsed"), F.min(F.struct("file", "record", "at")).alias("first"))
    total = records.select(F.count("*").alias("total"))
    return found.join(F.broadcast(total)).select("key", "present", (F.col("parsed") >= NUMERIC_SHARE * F.col("total")).alias("is_numeric"), "first")


def read_sdf_long(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, key, value, number): a row per molecule and property, at any number of names.

    `number` is set for properties that are numeric as a whole.
    """
    return _with_numbers(materialize(read_sdf_records(spark, path), "molecules"))


def _with_numbers(records: DataFrame) -> DataFrame:
    numeric = materialize(sdf_keys(records).where("is_numeric").select(F.col("key").alias("__key")), "keys")
    if numeric.count() <= BROADCAST_KEYS:
        numeric = F.broadcast(numeric)
    rows = sdf_values(records).join(numeric, F.col("key") == F.col("__key"), "left")
    return rows.select("file", "record", "key", "value", F.when(F.col("__key").isNotNull(), to_number(F.col("value"))).alias("number"))


def read_sdf_maps(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, Name, Sequence, properties, numbers): properties as a map, and the numeric ones as a map of numbers."""
    return _as_maps(materialize(read_sdf_records(spark, path), "molecules"))


def _as_maps(records: DataFrame) -> DataFrame:
    entries = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("key", "number")))
    maps = _with_numbers(records).groupBy(F.col("file").alias("__file"), F.col("record").alias("__record")).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"), F.map_from_entries(entries).alias("numbers")
    )
    same = (F.col("file") == F.col("__file")) & (F.col("record") == F.col("__record"))
    empty = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
    return records.drop("properties").join(maps, same, "left").select(
        "file", "record", "Name", "Sequence", F.coalesce("properties", empty[0]).alias("properties"), F.coalesce("numbers", empty[1]).alias("numbers")
    )


def read_sdf(spark: SparkSession, path: str, properties: Sequence[str] | None = None) -> DataFrame:
    """Wide molecule table of the wanted properties, or of all names found, in file order.

    A property that parses as a number in at least 80 % of all rows becomes numeric. Without a list and with more than
    `MOST_COLUMNS` names the table has the properties as maps instead, as `read_sdf_maps` gives them.
    """
    records = materialize(read_sdf_records(spark, path), "molecules")
    keys = sdf_keys(records).where("key not in ('Name', 'Sequence')")
    if properties is None:
        found = keys.orderBy("first").limit(MOST_COLUMNS + 1).select("key", "is_numeric").collect()
        if len(found) > MOST_COLUMNS:
            return _as_maps(records)
        properties = [r["key"] for r in found]
    else:
        found = keys.where(F.col("key").isin(*properties)).select("key", "is_numeric").collect() if properties else []
    numeric = {r["key"] for r in found if r["is_numeric"]}
    values = {p: property_value(F.col("properties"), p) for p in properties}
    return records.select(
        "file", "record", "Name", "Sequence", *[(to_number(v) if p in numeric else v).alias(p) for p, v in values.items()]
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A text file that is FASTA, a delimited table or a list, in this order of preference.

    The delimiter is that of the first line with text of every file; files that differ are an error.
    """
    lines = spark.read.text(path)
    if not lines.filter(F.ltrim("value").startswith(">")).isEmpty():
        return read_fasta(spark, path)
    line = F.regexp_replace(F.rtrim(F.regexp_replace("value", "\r", "")), "^ +", "")
    found = F.lit(None).cast("string")
    for sep in reversed(DELIMITERS):
        found = F.when(line.contains(sep), sep).otherwise(found)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    heads = lines.select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"), found.alias("sep"))
    heads = heads.filter(F.trim("value") != "").groupBy("file").agg(F.min_by(F.struct("sep"), "place")["sep"].alias("sep"))
    kinds = [r["sep"] for r in heads.select("sep").distinct().collect()]  # at most one row per delimiter
    if len(kinds) > 1:
        raise ValueError(f"The files of {path} have different delimiters: {sorted(map(str, kinds))}")
    return read_csv(spark, path, sep=kinds[0]) if kinds and kinds[0] else read_sequence_list(spark, path)


_READERS = {".csv": read_csv, ".fasta": read_fasta, ".fa": read_fasta, ".faa": read_fasta, ".sdf": read_sdf, ".txt": read_text}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read by file extension."""
    extension = PurePosixPath(path).suffix.lower()
    if extension == ".parquet":
        return spark.read.parquet(path)
    if extension not in _READERS:
        raise ValueError(f"Unsupported file format: {extension}")
    return _READERS[extension](spark, path)
