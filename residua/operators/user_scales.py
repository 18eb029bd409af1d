"""Residue scales and screening windows that come as tables, for the DataFrame API and for SQL.

A scale table has a row (scale, residue, value) per scale and residue, a criteria table a row (screen, criterion, low, high) per
window. `register_sql` makes the same expressions callable from SQL:

    SELECT p.id, s.scale, scale_sum(p.sequence, s.residue_values) FROM peptides p CROSS JOIN scale_maps s

Rules: the sum of a scale over a sequence is null if the scale lacks one of its residues, and over the empty sequence 0;
of a (scale, residue) that occurs more than once the largest value counts. A window without a lower or upper end is open there; a missing
descriptor value does not pass; windows of descriptors the table does not have are left out, so a screen of only such
windows gives no rows. Several windows of one descriptor count one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from residua.functions import constants as K
from residua.functions.sequences import clean_sequence, to_number
from residua.operators.storage import materialize

#: Scales, or windows, that are broadcast at once: at 20 residues a few MB. More go block by block.
BROADCAST_ROWS = 10_000

#: Longer sequences are summed letter by distinct letter.
SHORT = 64
_COUNT = "length({s}) - length(replace({s}, c, ''))"
_SUM = (
    "CASE WHEN {s} = '' THEN CAST(0 AS DOUBLE) "
    f"WHEN length({{s}}) <= {SHORT} THEN aggregate(split({{s}}, ''), CAST(0 AS DOUBLE), (t, c) -> t + try_element_at({{m}}, c)) "
    "ELSE aggregate(array_distinct(split({s}, '')), CAST(0 AS DOUBLE), (t, c) -> t + (" + _COUNT + ") * try_element_at({m}, c)) END"
)
_MEAN = "try_divide(" + _SUM + ", length({s}))"
#: The distinct letters of a sequence and how often each occurs, and their sum under a scale.
_LETTERS = "CASE WHEN {s} = '' THEN array() ELSE transform(array_distinct(split({s}, '')), c -> struct(c AS letter, " + _COUNT + " AS n)) END"
_SUM_OF_LETTERS = "aggregate({c}, CAST(0 AS DOUBLE), (t, e) -> t + e.n * try_element_at({m}, e.letter))"
_MET = "coalesce(CAST(({v} >= {low} OR {low} IS NULL) AND ({v} <= {high} OR {high} IS NULL) AND {v} IS NOT NULL AS INT), 0)"
FUNCTIONS = {
    "scale_sum": ("s STRING, m MAP<STRING, DOUBLE>", "DOUBLE", _SUM.format(s="s", m="m")),
    "scale_mean": ("s STRING, m MAP<STRING, DOUBLE>", "DOUBLE", _MEAN.format(s="s", m="m")),
    "window_met": ("v DOUBLE, low DOUBLE, high DOUBLE", "INT", _MET.format(v="v", low="low", high="high")),
}


def register_sql(spark: SparkSession, scales: DataFrame | None = None, view: str = "scale_maps") -> None:
    """Temporary functions `scale_sum`, `scale_mean`, `window_met`, and the scales as a view (scale, residue_values)."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    if scales is not None:
        scale_maps(scales).createOrReplaceTempView(view)


def scale_maps(scales: DataFrame) -> DataFrame:
    """`scale` and `residue_values`, a map of the residues that have a value."""
    single = scales.where("scale IS NOT NULL AND residue IS NOT NULL AND value IS NOT NULL")
    single = single.groupBy("scale", F.upper("residue").alias("residue")).agg(F.max(F.col("value").cast("double")).alias("value"))
    return single.groupBy("scale").agg(F.map_from_entries(F.collect_list(F.struct("residue", "value"))).alias("residue_values"))


def _blocks(table: DataFrame) -> list[DataFrame]:
    """The table in parts that may be broadcast."""
    stored = materialize(table, "user-table")
    count = -(-stored.count() // BROADCAST_ROWS)
    if count <= 1:
        return [F.broadcast(stored)]
    part = F.pmod(F.xxhash64(*[c for c in table.columns if c != "residue_values"]), F.lit(2 * count))
    return [F.broadcast(stored.where(part == n)) for n in range(2 * count)]


def scale_sums(df: DataFrame, id_cols: Sequence[str], scales: DataFrame, sequence_col: str = "Sequence") -> DataFrame:
    """`id_cols`, `scale`, `total` and `mean` of every sequence under every scale. The letters of a sequence are counted once for all scales."""
    cleaned = df.select(*id_cols, clean_sequence(F.col(f"`{sequence_col}`")).alias("__s"))
    counted = cleaned.select(*id_cols, F.length("__s").alias("__length"), F.expr(_LETTERS.format(s="__s")).alias("__letters"))
    out = None
    for block in _blocks(scale_maps(scales)):
        scored = counted.join(block).select(*id_cols, "scale", "__length", F.expr(_SUM_OF_LETTERS.format(c="__letters", m="residue_values")).alias("total"))
        scored = scored.select(*id_cols, "scale", "total", F.expr("try_divide(total, __length)").alias("mean"))
        out = scored if out is None else out.unionByName(scored)
    return out


def screen_by_table(df: DataFrame, id_cols: Sequence[str], criteria: DataFrame) -> DataFrame:
    """Windows met, windows in all, percent score and assessment of every row under every screen of the table.

    The descriptors named by the windows become (criterion, value) rows, which meet the windows in a join; counts
    are combined before the shuffle. `id_cols` tell rows apart: rows that share them are screened together.
    """
    types = dict(df.dtypes)
    named = [r[0] for r in criteria.select("criterion").where("criterion IS NOT NULL").distinct().collect() if r[0] in types]  # at most the columns
    windows = criteria.where(F.col("criterion").isin(named)).select("screen", "criterion", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    values = F.array(*[F.struct(F.lit(c).alias("criterion"), to_number(F.col(f"`{c}`"), types[c]).alias("v")) for c in sorted(named)])
    rows = df.select(*id_cols, F.explode(values if named else F.array().cast("array<struct<criterion:string,v:double>>")).alias("x"))
    rows = rows.select(*id_cols, F.col("x.criterion").alias("criterion"), F.col("x.v").alias("v"))
    met = F.expr(_MET.format(v="v", low="low", high="high"))
    out = None
    for block in _blocks(windows):
        found = rows.join(block, "criterion").groupBy(*id_cols, "screen").agg(F.sum(met).alias("passed"), F.count("*").alias("windows"))
        out = found if out is None else out.unionByName(found)
    out = out.groupBy(*id_cols, "screen").agg(F.sum("passed").alias("CriteriaPassCount"), F.sum("windows").alias("CriteriaTotal"))
    out = out.withColumn("StructureQualityScore", F.col("CriteriaPassCount") / F.col("CriteriaTotal") * 100.0)
    label = F.lit(K.LOWEST_ASSESSMENT)
    for lowest, name in reversed(K.ASSESSMENTS):
        label = F.when(F.col("StructureQualityScore") >= lowest, name).otherwise(label)
    return out.withColumn("StructureAssessment", label)
