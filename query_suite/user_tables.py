"""Residue scales and screening windows from tables, here made from `nation` and `region`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.analysis import _LABEL_SQL, FEATURES
from query_suite.features import PEP_SOURCE
from query_suite.registry import query, rounded
from query_suite.sequences import descriptor_cte
from residua.functions import constants as K
from residua.functions.descriptors import with_descriptors
from residua.operators import user_scales as U

_SCALES = """SELECT concat('scale_', cast(n_nationkey AS STRING)) AS scale, residue, ((n_nationkey * 13 + ascii(residue) * 7) % 23 - 11) / 4.0 AS value
  FROM (SELECT n_nationkey, {explode} AS residue FROM {nation}) WHERE (n_nationkey + ascii(residue)) % 29 <> 0"""
_WINDOWS = [(c, float(low), float(high)) for c, (low, high) in K.DEFAULT_CRITERIA.items()] + [("NoSuchDescriptor", 0.0, 1.0)]
_CRITERIA = """SELECT concat('screen_', cast(r_regionkey AS STRING)) AS screen, criterion, lo + r_regionkey * 0.0517 * (hi - lo) AS low,
    CASE WHEN r_regionkey = 4 AND criterion = 'Length' THEN NULL ELSE hi - r_regionkey * 0.1013 * (hi - lo) END AS high
  FROM {region}, (VALUES {windows}) AS w(criterion, lo, hi) WHERE criterion <> 'Gravy' OR r_regionkey <> 2"""
_LISTED = ", ".join(f"('{c}', cast({low} AS DOUBLE), cast({high} AS DOUBLE))" for c, low, high in _WINDOWS)
_LETTERS = ", ".join(f"'{aa}'" for aa in K.ALPHABET)

SCALES_SQL = "scales AS (" + _SCALES.format(explode=f"unnest([{_LETTERS}])", nation="nation").replace("AS STRING", "AS VARCHAR") + ")"
CRITERIA_SQL = "criteria AS (" + _CRITERIA.format(region="region", windows=_LISTED).replace("AS STRING", "AS VARCHAR") + ")"
_TOTALS_SQL = f"""WITH {I.PEP_SQL}, {SCALES_SQL}, counted AS (SELECT pep_id, scale, length(sequence) AS len, value, length(sequence) - length(replace(sequence, residue, '')) AS n FROM pep, scales),
  totals AS (SELECT pep_id, scale, CASE WHEN sum(n) = any_value(len) THEN sum(n * CAST(value AS DOUBLE)) END AS total, any_value(len) AS len FROM counted GROUP BY pep_id, scale)"""


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SCALES.format(explode=f"explode(array({_LETTERS}))", nation="{src}"), src=I.table(spark, sf_dir, "nation"))


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CRITERIA.format(region="{src}", windows=_LISTED), src=I.table(spark, sf_dir, "region"))


@query(f"{_TOTALS_SQL} SELECT pep_id, scale, round(total, 6) + 0.0 AS total, round(total / len, 6) + 0.0 AS mean FROM totals")
def scales_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every peptide under every scale of a table."""
    return rounded(U.scale_sums(I.peptides(spark, sf_dir), ["pep_id"], scales(spark, sf_dir), "sequence"))


@query(f"{_TOTALS_SQL} SELECT scale, count(total) AS covered, round(avg(total / len), 6) + 0.0 AS mean, round(max(total), 6) + 0.0 AS most FROM totals GROUP BY scale")
def scales_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scales called from SQL."""
    U.register_sql(spark, scales(spark, sf_dir))
    I.peptides(spark, sf_dir).createOrReplaceTempView("__peptides")
    return rounded(spark.sql(
        "SELECT scale, count(total) AS covered, avg(mean) AS mean, max(total) AS most FROM (SELECT s.scale, scale_sum(p.sequence, s.residue_values) AS total, "
        "scale_mean(p.sequence, s.residue_values) AS mean FROM __peptides p CROSS JOIN scale_maps s) GROUP BY scale"
    ))


_SCREENED_SQL = f"""{descriptor_cte(FEATURES, PEP_SOURCE)}, {CRITERIA_SQL},
  long AS ({" UNION ALL ".join(f"SELECT pep_id, '{c}' AS criterion, CAST(\"{c}\" AS DOUBLE) AS v FROM described" for c in FEATURES)}),
  met AS (SELECT pep_id, screen, CAST(v >= coalesce(low, v) AND v <= coalesce(high, v) AS BIGINT) AS ok FROM long JOIN criteria USING (criterion)),
  counted AS (SELECT pep_id, screen, sum(ok)::BIGINT AS passed, count(*) AS windows, sum(ok) / count(*) * 100.0 AS quality FROM met GROUP BY pep_id, screen)"""


@query(f"""{_SCREENED_SQL} SELECT pep_id, screen, passed AS "CriteriaPassCount", windows AS "CriteriaTotal", round(quality, 6) + 0.0 AS "StructureQualityScore",
  {_LABEL_SQL} AS "StructureAssessment" FROM counted""")
def screens_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every peptide under every screen of a table of windows."""
    described = with_descriptors(I.peptides(spark, sf_dir), "sequence", only=FEATURES)
    return rounded(U.screen_by_table(described, ["pep_id"], criteria(spark, sf_dir)))


@query(f"""{_SCREENED_SQL} SELECT screen, count(*) AS "rows", sum(passed)::BIGINT AS passed FROM counted GROUP BY screen""")
def screens_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the table met in SQL, on descriptors as rows."""
    U.register_sql(spark)
    with_descriptors(I.peptides(spark, sf_dir), "sequence", only=FEATURES).createOrReplaceTempView("__described")
    criteria(spark, sf_dir).createOrReplaceTempView("__criteria")
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
    return spark.sql(f"""SELECT c.screen, count(DISTINCT pep_id) AS rows, sum(window_met(d.v, c.low, c.high)) AS passed
      FROM (SELECT * FROM (SELECT pep_id, {columns} FROM __described) UNPIVOT INCLUDE NULLS (v FOR criterion IN ({", ".join(FEATURES)}))) d
      JOIN __criteria c ON c.criterion = d.criterion GROUP BY c.screen""")
