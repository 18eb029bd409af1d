"""Peptide tables derived from the driver's tables, by expressions that both engines share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from residua.operators.storage import spread

ORDER = ["row_id", "l_partkey", "l_suppkey", "activity"]


def tune(spark: SparkSession) -> None:
    """Let wide projections fall back to many small methods that the JVM compiles to machine code."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _core(seed: str, size: str) -> str:
    return (
        f"concat(translate(substr(md5(cast({seed} AS STRING)), 1, cast(4 + {size} % 9 AS INT)), "
        "'0123456789abcdef', 'ACDEFGHIKLMNPQRS'), "
        f"translate(substr(md5(concat(cast({seed} AS STRING), 'x')), 1, cast(3 + {size} % 8 AS INT)), "
        "'0123456789abcdef', 'TVWYKRHFLIVAGDEQ'))"
    )


_PEP = f"SELECT p_partkey AS pep_id, {_core('p_partkey', 'p_partkey')} AS sequence, p_retailprice AS activity FROM {{part}}"

_RAW = f"""
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey, l_suppkey, l_extendedprice AS activity,
       concat('Pep_', cast(l_orderkey * 10 + l_linenumber AS STRING)) AS name,
       CASE WHEN l_linenumber = 5 THEN '   ' WHEN l_linenumber = 4 THEN NULL
            WHEN l_linenumber = 3 THEN concat(core, 'BX*')
            WHEN l_linenumber = 2 THEN concat(' ', lower(substr(core, 1, 3)), ' ', substr(core, 4))
            ELSE core END AS sequence
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
             {_core('(l_orderkey % 997)', 'l_orderkey')} AS core FROM {{lineitem}})
"""

_RAW_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_LABELED = """
SELECT doc_id, quality, toxic,
       CASE WHEN (doc_id * 7 + 3) % 5 < 3 THEN quality ELSE 1 - quality END AS predicted,
       CASE WHEN doc_id % 4 = 0 THEN 'low' WHEN quality = 1 THEN 'mid' ELSE 'high' END AS actual3,
       CASE WHEN (doc_id * 5) % 7 < 2 THEN 'low' WHEN toxic = 1 THEN 'high' ELSE 'mid' END AS predicted3,
       cast((doc_id * 37) % 101 AS DOUBLE) / 101.0 AS score
FROM {labels}
"""


_LONG = """
SELECT doc_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS sequence,
       -abs(cast(n_chars AS DOUBLE) - 1000.0) AS activity
FROM {documents}
"""


_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))
_NO_RESIDUE = bytes(c for c in range(256) if c not in b"ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy")


def _residues(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_LONG` in one pass over the bytes: those of other characters are never letters of the alphabet."""
    for batch in rows:
        texts = (t.as_py() for t in batch.column(1))
        sequences = [None if t is None else t.encode().translate(_UPPER, _NO_RESIDUE).decode() for t in texts]
        activity = pc.negate(pc.abs(pc.subtract(pc.cast(batch.column(2), pa.float64()), 1000.0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequences, pa.string()), activity], ["doc_id", "sequence", "activity"])


def long_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of up to many thousand residues: the letters of the alphabet in every text."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    return rows.mapInArrow(_residues, f"doc_id {dict(rows.dtypes)['doc_id']}, sequence string, activity double")


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean distinct peptides with a measured value, one per part."""
    return spark.sql(_PEP.format(part="{src}"), src=spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey"))


def raw_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty peptides, one per line item: blanks, gaps, lower case, foreign letters, repeats."""
    return spark.sql(_RAW.format(lineitem="{src}"), src=spread(table(spark, sf_dir, "lineitem").select(*_RAW_COLUMNS), "l_orderkey"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LABELED.format(labels="{src}"), src=table(spark, sf_dir, "labels"))


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


PEP_SQL = f"pep AS ({_duck(_PEP.format(part='part'))})"
RAW_SQL = f"raw_pep AS ({_duck(_RAW.format(lineitem='lineitem'))})"
CLEAN_SQL = RAW_SQL + """, cleaned AS (
    SELECT * REPLACE (upper(regexp_replace(coalesce(sequence, ''), '\\s+', '', 'g')) AS sequence) FROM raw_pep),
  filled AS (SELECT *, translate(sequence, 'ACDEFGHIKLMNPQRSTVWY', '') AS foreign_part FROM cleaned WHERE sequence <> ''),
  valid AS (SELECT row_id, l_partkey, l_suppkey, activity, name, sequence FROM filled WHERE foreign_part = '')"""
LONG_SQL = f"valid AS (SELECT * FROM ({_LONG.format(documents='documents')}) WHERE sequence <> '')"
LABELED_SQL = f"labeled AS ({_duck(_LABELED.format(labels='labels'))})"
