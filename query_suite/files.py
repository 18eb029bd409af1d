"""Readers and writers: each query writes files from the given tables and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.registry import query, rounded
from residua.operators import validation as V
from residua.operators.storage import scratch_directory
from residua.sources import readers as RD
from residua.sources import writers as WR


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_directory(spark)}/{name}-{uuid.uuid4().hex}"


_NAMED_SQL = f"""WITH {I.PEP_SQL}, named AS (SELECT 'Pep_' || pep_id AS "Name", sequence AS "Sequence", activity, pep_id FROM pep)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.peptides(spark, sf_dir).select(
        F.concat(F.lit("Pep_"), F.col("pep_id").cast("string")).alias("Name"), F.col("sequence").alias("Sequence"), "activity", "pep_id"
    )


@query(f'{_NAMED_SQL} SELECT "Name", "Sequence" FROM named')
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "fasta")
    WR.write_fasta(_named(spark, sf_dir).repartition(4), path)
    return RD.read_fasta(spark, path).select("Name", "Sequence")


@query(f"""{_NAMED_SQL} SELECT "Name", "Sequence" FROM named""")
def fasta_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded lower-case sequence lines, blank lines, carriage returns and text before the first header."""
    path = _folder(spark, "folded")
    pep = _named(spark, sf_dir)
    record = F.concat(
        F.lit(">"), F.col("Name"), F.lit(" \r\n"), F.lower(F.substring("Sequence", 1, 4)), F.lit("\r\n\r\n "),
        F.col("Sequence").substr(F.lit(5), F.length("Sequence")), F.lit("\r"),
    )
    junk = spark.range(4).select("id", F.lit(0).alias("line"), F.lit("; text before the first record").alias("value"))
    rows = junk.unionByName(pep.select((F.col("pep_id") % 4).alias("id"), F.lit(1).alias("line"), record.alias("value")))
    rows.repartition(4, "id").sortWithinPartitions("line").select("value").write.text(path)
    return RD.read_fasta(spark, path).select("Name", "Sequence")


@query(f"""{_NAMED_SQL} SELECT 'mol ' || pep_id AS "Name", "Sequence", CASE WHEN pep_id % 3 = 0 THEN "Sequence" END AS "AA Sequence", CASE WHEN pep_id % 3 = 1 THEN "Sequence" END AS remark,
       activity AS "Activity", CASE WHEN pep_id % 2 = 0 THEN 'high ' || pep_id END AS note
       FROM named WHERE pep_id % 3 < 2
       UNION ALL SELECT "Sequence", "Sequence", NULL, NULL, activity, CASE WHEN pep_id % 2 = 0 THEN 'high ' || pep_id END FROM named WHERE pep_id % 3 = 2""")
def sdf_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules whose sequence stands in a known property, in an unknown one, or only in the title."""
    path = _folder(spark, "sdf")
    kind = F.col("pep_id") % 3
    block = F.concat(
        F.when(kind == 2, F.col("Sequence")).otherwise(F.concat(F.lit("mol "), F.col("pep_id").cast("string"))),
        F.lit("\n  generated\n\n  0  0\nM  END\n"),
        F.when(kind == 0, F.concat(F.lit("> <AA Sequence>\n"), F.col("Sequence"), F.lit("\n\n")))
        .when(kind == 1, F.concat(F.lit(">  <remark>\n"), F.lower("Sequence"), F.lit("\n\n"))).otherwise(""),
        F.lit("> <Activity>\n"), F.col("activity").cast("string"), F.lit("\n\n"),
        F.when(F.col("pep_id") % 2 == 0, F.concat(F.lit("> <note>\nhigh\n "), F.col("pep_id").cast("string"), F.lit("\n\n"))).otherwise(""),
        F.lit("$$$$"),
    )
    _named(spark, sf_dir).repartition(4).select(block.alias("value")).write.text(path)
    table = RD.read_sdf(spark, path).withColumn("remark", F.upper("remark"))
    return rounded(table.select("Name", "Sequence", "AA Sequence", "remark", "Activity", "note"))


_MANY = 8


@query(f"""WITH {I.PEP_SQL}, named AS (SELECT 'mol ' || pep_id AS "Name", pep_id, activity FROM pep),
  long AS (SELECT "Name", 'own ' || (pep_id * {_MANY} + i) AS key, CAST(i AS VARCHAR) AS value, NULL AS number FROM named, range({_MANY}) t(i)
    UNION ALL SELECT "Name", 'Activity', CAST(activity AS VARCHAR), activity FROM named
    UNION ALL SELECT "Name", 'again', 'last', NULL FROM named WHERE pep_id % 5 = 0)
  SELECT "Name", key, CASE WHEN key <> 'Activity' THEN value END AS value, round(CAST(number AS DOUBLE), 6) AS number FROM long""")
def sdf_many_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every molecule has property names of its own, far more than columns; one name is common, one is given twice."""
    path = _folder(spark, "many")
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_MANY - 1)), lambda i: F.concat(
        F.lit("> <own "), (F.col("pep_id") * _MANY + i).cast("string"), F.lit(">\n"), i.cast("string"), F.lit("\n\n"))), "")
    again = F.when(F.col("pep_id") % 5 == 0, F.lit("> <again>\nfirst\n\n> <again>\nlast\n\n")).otherwise("")
    block = F.concat(
        F.lit("mol "), F.col("pep_id").cast("string"), F.lit("\n  generated\n\n  0  0\nM  END\n"), own,
        F.lit("> <Activity>\n"), F.col("activity").cast("string"), F.lit("\n\n"), again, F.lit("$$$$"),
    )
    _named(spark, sf_dir).repartition(4).select(block.alias("value")).write.text(path)
    table = RD.read_sdf_maps(spark, path)
    rows = table.select("Name", "numbers", F.explode("properties").alias("key", "value"))
    value = F.when(F.col("key") != "Activity", F.col("value"))  # its digits are compared as a number
    return rounded(rows.select("Name", "key", value.alias("value"), F.try_element_at("numbers", F.col("key")).alias("number")))


@query("""WITH t AS (SELECT p_partkey, p_name || ' , ' || p_type AS txt FROM part), pieces AS (SELECT p_partkey, list_filter(regexp_split_to_array(trim(txt), '[\\n,;\\t ]+'), lambda x: x <> '') AS l FROM t)
       SELECT p_partkey, i AS record, 'Manual_' || i AS "Name", upper(l[i]) AS "Sequence" FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM pieces)""")
def text_block_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" , "), "p_type").alias("text"))
    return rounded(RD.parse_sequence_blocks(part, "text"))


@query(f'{_NAMED_SQL} SELECT "Sequence" FROM named')
def sequence_list_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file without header or record marks: several sequences per line."""
    path = _folder(spark, "list")
    grouped = _named(spark, sf_dir).groupBy((F.col("pep_id") / 3).cast("bigint").alias("g")).agg(
        F.array_join(F.array_sort(F.collect_list(F.lower("Sequence"))), "; ").alias("value")
    )
    grouped.select("value").write.text(path)
    return RD.read_sequence_list(spark, path).select("Sequence")


@query(f'{_NAMED_SQL} SELECT "Name", "Sequence", round(activity, 6) AS activity, pep_id FROM named')
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    WR.write_csv(_named(spark, sf_dir), path)
    return rounded(RD.read_csv(spark, path))


@query(f'{_NAMED_SQL} SELECT "Name", "Sequence", round(activity, 6) AS activity, pep_id FROM named')
def delimited_text_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tab")
    _named(spark, sf_dir).coalesce(1).write.option("header", True).option("sep", "|").csv(path)
    return rounded(RD.read_text(spark, path))


@query(f'{_NAMED_SQL} SELECT "Name", "Sequence", pep_id FROM named')
def table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tables")
    named = _named(spark, sf_dir).drop("activity")
    written = WR.write_tables({"ValidatedInput": named}, path)
    return spark.read.parquet(written[0])


@query("""SELECT 'l_comment_free' AS label, CAST(NULL AS VARCHAR) AS sequence_column, 'l_extendedprice,l_quantity' AS numeric_columns
          UNION ALL SELECT 'renamed', 'some text', 'activity'""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence column by content, and usable numeric targets, on whole tables."""
    items = I.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    plain = _named(spark, sf_dir).select(F.col("Sequence").alias("some text"), "activity", F.col("Name").alias("name"))
    rows = []
    for label, df in (("l_comment_free", items), ("renamed", plain)):
        targets = V.numeric_targets(df, [])
        rows.append((label, V.guess_sequence_column(df), ",".join(sorted(targets))))
    return spark.createDataFrame(rows, "label string, sequence_column string, numeric_columns string")
