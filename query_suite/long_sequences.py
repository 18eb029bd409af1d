"""The sequence operators on sequences of many thousand residues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.analysis import _ALIGN_SQL
from query_suite.registry import query, rounded
from query_suite.sequences import descriptor_cte
from residua.functions.descriptors import with_descriptors
from residua.operators import design as D

NAMES = ["Length", "Gravy", "NetCharge_pH7", "AAC_A", "Motif_KK"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.long_peptides(spark, sf_dir).where("sequence <> ''")


@query(f"""{descriptor_cte(NAMES, I.LONG_SQL)} SELECT doc_id, {", ".join(f'round(CAST("{n}" AS DOUBLE), 6) + 0.0 AS "{n}"' for n in NAMES)} FROM described""")
def descriptors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_descriptors(_rows(spark, sf_dir), "sequence", only=NAMES)
    return rounded(found.select("doc_id", *[F.col(n).cast("double").alias(n) for n in NAMES]))


@query(f"""WITH {I.LONG_SQL}, l AS (SELECT activity, unnest(string_split(sequence, '')) AS aa, unnest(range(1, length(sequence) + 1)) AS pos FROM valid),
  o AS (SELECT avg(activity) AS m FROM valid)
  SELECT CAST(pos AS BIGINT) AS "Position", aa AS "Residue", count(*) AS "Count", round(avg(activity), 9) + 0.0 AS "MeanTarget", round(avg(activity) - any_value(m), 9) + 0.0 AS "DeltaFromMean"
  FROM l, o GROUP BY pos, aa HAVING count(*) >= 2""")
def position_effects_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions of all sequences; no position is left out."""
    effects = D.position_effects(_rows(spark, sf_dir), "sequence", "activity", "maximize")
    return rounded(effects.select("Position", "Residue", "Count", "MeanTarget", "DeltaFromMean"), 9)


_LONG_ALIGN_SQL = (
    _ALIGN_SQL[_ALIGN_SQL.index(", pairs AS"):].replace("row_id, l_partkey, l_suppkey, name AS", "doc_id, '' AS").replace("changes[1:12]", "changes")
    .replace(" || CASE WHEN len(changes) > 12 THEN ' ...' ELSE '' END", "")
)


@query(f"""WITH {I.LONG_SQL}, best AS (SELECT 'Best reference' AS "ReferenceName", sequence AS "ReferenceSequence", activity AS "ReferenceTarget" FROM valid ORDER BY activity DESC, doc_id LIMIT 1)
  {_LONG_ALIGN_SQL} SELECT doc_id, "SequenceIdentityToReference", "EditSimilarityToReference", "EditDistanceToReference", "LengthDifference",
  md5("MutationSummaryVsReference") AS summary_md5 FROM aligned""")
def alignment_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change is listed, in one pass over both sequences."""
    found = D.alignment_to_reference(_rows(spark, sf_dir), "sequence", "activity", ["doc_id"], "maximize")
    return rounded(found.select(
        "doc_id", "SequenceIdentityToReference", "EditSimilarityToReference", "EditDistanceToReference", "LengthDifference",
        F.md5("MutationSummaryVsReference").alias("summary_md5"),
    ))
