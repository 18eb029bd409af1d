"""Cleaning, validation, duplicates, union and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.registry import query, rounded, sql_rounded
from residua.functions import constants as K
from residua.functions import descriptors as X
from residua.functions.sequences import clean_sequence
from residua.operators import validation as V

KEYS = ["row_id", "l_partkey", "l_suppkey"]
KEYS_SQL = "row_id, l_partkey, l_suppkey"
STD = K.ALPHABET


def tagged(spark: SparkSession, sf_dir: str) -> V.Validation:
    return V.validate_sequences(I.raw_peptides(spark, sf_dir), "sequence", I.ORDER)


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).tagged.filter(F.col("status") == V.VALID).drop("status", "InvalidCharacters")


def described(spark: SparkSession, sf_dir: str, only: list[str]) -> DataFrame:
    """Keys, sequence and the named descriptors of every valid row."""
    return X.with_descriptors(valid_rows(spark, sf_dir), "sequence", only=only)


def _descriptor_query(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return rounded(described(spark, sf_dir, names).select(*KEYS, F.col("Sequence").alias("sequence"), *names))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


SCALE_NAMES = list(K.SCALES)
RESIDUE_SQL = "residue(aa, {}) AS (VALUES {})".format(
    ", ".join(f"s_{n}" for n in SCALE_NAMES),
    _values([[aa] + [K.SCALES[n][aa] for n in SCALE_NAMES] for aa in STD]),
)
PAIR_SQL = f"pair_weight(pair, w) AS (VALUES {_values(K.instability_exceptions().items())})"
LETTERS_SQL = (
    RESIDUE_SQL + ", " + PAIR_SQL + """,
  distinct_sequences AS (SELECT DISTINCT sequence FROM valid),
  letters AS (SELECT sequence, length(sequence) AS len, i, substr(sequence, i, 1) AS aa, substr(sequence, i, 2) AS pair
              FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS i FROM distinct_sequences))"""
)
_COUNTS = ", ".join(f"sum(CASE WHEN aa = '{aa}' THEN 1 ELSE 0 END) AS n_{aa}" for aa in STD)
_SUMS = ", ".join(f"sum(s_{n}) AS t_{n}" for n in SCALE_NAMES)
PER_SEQUENCE_SQL = LETTERS_SQL + f""",
  totals AS (SELECT sequence, any_value(len) AS len, {_COUNTS}, {_SUMS},
                    sqrt(pow(sum(s_kd * cos((i - 1) * radians(100))), 2) + pow(sum(s_kd * sin((i - 1) * radians(100))), 2)) / any_value(len) AS moment,
                    10.0 / any_value(len) * sum(CASE WHEN length(pair) = 2 THEN coalesce(w, 1.0) ELSE 0 END) AS instability
             FROM letters JOIN residue USING (aa) LEFT JOIN pair_weight USING (pair) GROUP BY sequence)"""


def _pk_case(letter: str, table: dict[str, float], default: float) -> str:
    branches = " ".join(f"WHEN '{aa}' THEN {pk}" for aa, pk in table.items())
    return f"CASE {letter} {branches} ELSE {default} END"


def _charge_sql(ph: str) -> str:
    positive = [f"1.0 / (pow(10, {ph} - pk_n) + 1)"]
    positive += [f"n_{aa} / (pow(10, {ph} - {pk}) + 1)" for aa, pk in K.POSITIVE_PK.items()]
    negative = [f"1.0 / (pow(10, pk_c - {ph}) + 1)"]
    negative += [f"n_{aa} / (pow(10, {pk} - {ph}) + 1)" for aa, pk in K.NEGATIVE_PK.items()]
    return f"(({' + '.join(positive)}) - ({' + '.join(negative)}))"


def _fraction_sql(letters: str) -> str:
    return "(" + " + ".join(f"n_{aa}" for aa in letters) + ") / len"


CHARGE_SQL = PER_SEQUENCE_SQL + f""",
  ends AS (SELECT *, {_pk_case("substr(sequence, 1, 1)", K.N_TERMINUS_PK_BY_RESIDUE, K.N_TERMINUS_PK)} AS pk_n,
                  {_pk_case("substr(sequence, len, 1)", K.C_TERMINUS_PK_BY_RESIDUE, K.C_TERMINUS_PK)} AS pk_c FROM totals),
  charged AS (SELECT *, {_charge_sql('7.0')} AS charge FROM ends)"""


def _bisection_sql() -> str:
    steps = [f"pi0 AS (SELECT *, cast({K.PI_START} AS DOUBLE) AS ph, cast({K.PI_LOW} AS DOUBLE) AS lo, cast({K.PI_HIGH} AS DOUBLE) AS hi FROM charged)"]
    for k in range(K.PI_STEPS):
        steps.append(
            f"pi{k + 1} AS (SELECT * REPLACE (CASE WHEN up THEN ph ELSE lo END AS lo, CASE WHEN up THEN hi ELSE ph END AS hi, "
            f"CASE WHEN up THEN (ph + hi) / 2 ELSE (lo + ph) / 2 END AS ph) "
            f"FROM (SELECT * {'EXCLUDE (up)' if k else ''}, {_charge_sql('ph')} > 0 AS up FROM pi{k}))"
        )
    return CHARGE_SQL + ", " + ", ".join(steps)


# Descriptor name -> SQL over the per-sequence table.
DESCRIPTOR_SQL = {
    "Length": "len",
    "MolecularWeight": f"t_mass - (len - 1) * {K.WATER_MASS}",
    "Aromaticity": _fraction_sql("FWY"),
    "Hydrophobicity_KD": "t_kd / len",
    "NetCharge_pH7": "charge",
    "IsoelectricPoint": "ph",
    "InstabilityIndex": "instability",
    "Gravy": "t_kd / len",
    "AliphaticIndex": "n_A / len * 100.0 + 2.9 * (n_V / len * 100.0) + 3.9 * ((n_I + n_L) / len * 100.0)",
    "BomanIndex": "t_boman / len",
    "ShannonEntropy": "-(" + " + ".join(f"CASE WHEN n_{aa} > 0 THEN (n_{aa} / len) * log2(n_{aa} / len) ELSE 0 END" for aa in STD) + ")",
    "ChargeDensity": "charge / len",
    "HydrophobicMoment100": "moment",
    **{name: _fraction_sql(letters) for name, letters in K.STRUCTURE_SETS.items()},
    "HelixPropensityAvg": "t_helix / len",
    "SheetPropensityAvg": "t_sheet / len",
    "ExtCoeffReduced": "5500.0 * n_W + 1490.0 * n_Y",
    "ExtCoeffOxidized": "5500.0 * n_W + 1490.0 * n_Y + 125.0 * floor(n_C / 2)",
    **{f"AAC_{aa}": f"n_{aa} / len" for aa in STD},
    **{name: _fraction_sql(letters) for name, letters in K.RESIDUE_CLASSES.items()},
}
_ATOMS = {e: f"(t_{e} + {2 if e == 'H' else 1 if e == 'O' else 0})" for e in K.ELEMENTS}
DESCRIPTOR_SQL |= {f"Elem_{e}": _ATOMS[e] for e in K.ELEMENTS}
DESCRIPTOR_SQL |= {f"Elem_{e}_fraction": f"{_ATOMS[e]} / ({' + '.join(_ATOMS.values())})" for e in "CNOS"}
DESCRIPTOR_SQL |= {
    f"Motif_{m}": f"CASE WHEN len < 2 THEN 0 ELSE len(regexp_extract_all(sequence, '{m}')) / (len - 1) END" for m in K.MOTIFS
}


def descriptor_cte(names: list[str], source_sql: str = I.CLEAN_SQL) -> str:
    """CTEs ending in `described`: every row of `valid` with the named descriptors, unrounded."""
    source = "pi17" if "IsoelectricPoint" in names else "charged"
    chain = _bisection_sql() if source == "pi17" else CHARGE_SQL
    columns = ", ".join(f'{DESCRIPTOR_SQL[n]} AS "{n}"' for n in names)
    return (
        f"WITH {source_sql}, {chain}, per_sequence AS (SELECT sequence, {columns} FROM {source}), "
        f"described AS (SELECT valid.*, per_sequence.* EXCLUDE (sequence) FROM valid JOIN per_sequence USING (sequence))"
    )


def _descriptor_sql(names: list[str]) -> str:
    integers = {"Length"}
    columns = ", ".join(
        f'CAST("{n}" AS BIGINT) AS "{n}"' if n in integers else f'round(CAST("{n}" AS DOUBLE), 6) + 0.0 AS "{n}"' for n in names
    )
    return f"{descriptor_cte(names)} SELECT {KEYS_SQL}, sequence, {columns} FROM described"


@query(f"WITH {I.CLEAN_SQL} SELECT {KEYS_SQL}, sequence FROM cleaned WHERE sequence <> ''")
def clean_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.raw_peptides(spark, sf_dir).withColumn("sequence", clean_sequence(F.col("sequence")))
    return raw.filter(F.length("sequence") > 0).select(*KEYS, "sequence")


@query(f"WITH {I.CLEAN_SQL} SELECT {KEYS_SQL}, sequence, CASE WHEN foreign_part = '' THEN 'valid' ELSE 'invalid' END AS status FROM filled")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).tagged.select(*KEYS, "sequence", "status")


@query(f"""WITH {I.CLEAN_SQL} SELECT {KEYS_SQL}, sequence,
           list_aggregate(list_sort(list_distinct(string_split(foreign_part, ''))), 'string_agg', '') AS "InvalidCharacters"
           FROM filled WHERE foreign_part <> ''""")
def invalid_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).invalid.select(*KEYS, "sequence", "InvalidCharacters")


@query(f"""WITH {I.CLEAN_SQL} SELECT {KEYS_SQL}, activity, sequence FROM valid
           WHERE sequence IN (SELECT sequence FROM valid GROUP BY sequence HAVING count(*) > 1)""")
def duplicates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).duplicates.select(*KEYS, "activity", "sequence")


@query(f"""WITH {I.CLEAN_SQL} SELECT {KEYS_SQL}, activity, name, sequence FROM valid
           QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY row_id, l_partkey, l_suppkey, activity) = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).valid.select(*KEYS, "activity", "name", "sequence")


@query(f"""WITH {I.CLEAN_SQL}, per_key AS (SELECT sequence, count(*) AS n FROM valid GROUP BY sequence)
           SELECT (SELECT count(*) FROM per_key) AS valid_unique,
                  (SELECT count(*) FROM filled WHERE foreign_part <> '') AS invalid_rows,
                  (SELECT CAST(sum(n) AS BIGINT) FROM per_key WHERE n > 1) AS duplicate_rows""")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).counts


@query(f"""WITH {I.PEP_SQL}
           SELECT CAST(0 AS BIGINT) AS source, pep_id, activity, sequence AS "Sequence", CAST(NULL AS VARCHAR) AS "Name" FROM pep
           UNION ALL BY NAME
           SELECT CAST(1 AS BIGINT) AS source, s_name AS "Name", upper(substr(md5(s_name), 1, 12)) AS "Sequence" FROM supplier""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = I.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("Name"), F.upper(F.substring(F.md5("s_name"), 1, 12)).alias("Sequence")
    )
    return rounded(V.union_sources(I.peptides(spark, sf_dir), manual, "sequence"))


@query(f"""WITH {I.PEP_SQL}, numbered AS (SELECT sequence, row_number() OVER (ORDER BY sequence, pep_id) AS n FROM pep)
           SELECT 'Peptide_' || n AS "Name", sequence FROM numbered""")
def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = V.with_default_names(I.peptides(spark, sf_dir), [F.col("sequence"), F.col("pep_id")])
    return named.select("Name", "sequence")


AAC = [f"AAC_{aa}" for aa in STD]


@query(_descriptor_sql(AAC))
def aac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, AAC)


CLASSES = list(K.RESIDUE_CLASSES) + list(K.STRUCTURE_SETS)


@query(_descriptor_sql(CLASSES))
def class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, CLASSES)


@query(_descriptor_sql(["ShannonEntropy"]))
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ["ShannonEntropy"])


@query(_descriptor_sql(list(X.ELEMENTAL)))
def elemental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, list(X.ELEMENTAL))


@query(_descriptor_sql(list(X.MOTIF)))
def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, list(X.MOTIF))


@query(f"""WITH {I.CLEAN_SQL}, numbered AS (SELECT *, row_number() OVER () AS rn FROM valid WHERE length(sequence) > 1),
           pairs AS (SELECT rn, {KEYS_SQL}, length(sequence) - 1 AS n, substr(sequence, i, 2) AS "Dipeptide"
                     FROM (SELECT *, unnest(range(1, length(sequence))) AS i FROM numbered))
           SELECT any_value(row_id) AS row_id, any_value(l_partkey) AS l_partkey, any_value(l_suppkey) AS l_suppkey, "Dipeptide", count(*) AS "Count",
                  round(count(*) / any_value(n), 6) + 0.0 AS "Frequency" FROM pairs GROUP BY rn, "Dipeptide" """)
def dipeptides_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.dipeptides_long(valid_rows(spark, sf_dir), KEYS, "sequence"))


WIDE_PAIRS = list(X.DIPEPTIDES)


@query(f"WITH {I.PEP_SQL} SELECT pep_id, " + ", ".join(
    f"""round(len(list_filter(range(1, length(sequence)), lambda i: substr(sequence, i, 2) = '{p}')) / (length(sequence) - 1), 6) + 0.0 AS "DPC_{p}" """
    for p in WIDE_PAIRS) + " FROM pep")
def dipeptides_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"DPC_{p}" for p in WIDE_PAIRS]
    return rounded(X.with_descriptors(I.peptides(spark, sf_dir), "sequence", only=names).select("pep_id", *names))


INDICES = ["Length", "MolecularWeight", "Gravy", "Hydrophobicity_KD", "Aromaticity", "AliphaticIndex", "BomanIndex", "HelixPropensityAvg", "SheetPropensityAvg"]


@query(_descriptor_sql(INDICES))
def mass_gravy_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, INDICES)


@query(_descriptor_sql(["NetCharge_pH7", "ChargeDensity"]))
def charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ["NetCharge_pH7", "ChargeDensity"])


@query(_descriptor_sql(["ExtCoeffReduced", "ExtCoeffOxidized"]))
def extinction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ["ExtCoeffReduced", "ExtCoeffOxidized"])


@query(_descriptor_sql(["HydrophobicMoment100"]))
def hydrophobic_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ["HydrophobicMoment100"])


@query(_descriptor_sql(["InstabilityIndex"]))
def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ["InstabilityIndex"])


@query(_descriptor_sql(["IsoelectricPoint"]))
def isoelectric_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ["IsoelectricPoint"])


ALL_DESCRIPTORS = X.descriptor_names()


@query(_descriptor_sql(ALL_DESCRIPTORS))
def descriptor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptor_query(spark, sf_dir, ALL_DESCRIPTORS)


@query(f"""WITH {I.RAW_SQL} SELECT 'activity' AS "column", count(activity) AS present, round(avg(1.0), 6) AS parsed_ratio FROM raw_pep
           UNION ALL SELECT 'name', count(name), round(avg(CASE WHEN TRY_CAST(name AS DOUBLE) IS NULL THEN 0 ELSE 1 END), 6) FROM raw_pep
           UNION ALL SELECT 'sequence', count(sequence), round(avg(CASE WHEN TRY_CAST(sequence AS DOUBLE) IS NULL THEN 0 ELSE 1 END), 6) FROM raw_pep""")
def parsed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.parsed_ratio(I.raw_peptides(spark, sf_dir), ["activity", "name", "sequence"]))


@query("SELECT count(DISTINCT o_orderpriority) AS classes FROM orders")
def class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.class_count(I.table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT min(n) AS smallest, count(*) AS classes FROM (SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)")
def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = V.class_sizes(I.table(spark, sf_dir, "orders"), "o_orderpriority")
    return sizes.agg(F.min("rows").alias("smallest"), F.count("*").alias("classes"))
