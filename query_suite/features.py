"""Feature preprocessing, selection, splits, folds, components and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from query_suite import inputs as I
from query_suite.registry import query, rounded
from query_suite.sequences import DESCRIPTOR_SQL, descriptor_cte
from residua.functions.descriptors import with_descriptors
from residua.operators import decomposition as PCA
from residua.operators import neighbors as NN
from residua.operators import preprocessing as P
from residua.operators import profiling as DP
from residua.operators import selection as SEL
from residua.operators import splitting as SP
from residua.operators.storage import materialize

FEATURES = ["Length", "MolecularWeight", "Gravy", "Hydrophobicity_KD", "NetCharge_pH7", "Aromaticity", "BomanIndex", "HydrophobicMoment100", "AAC_A", "Motif_KK"]
PEP_SOURCE = I.PEP_SQL + ", valid AS (SELECT pep_id, activity, sequence FROM pep)"
FEATURE_SQL = descriptor_cte(FEATURES, PEP_SOURCE) + ", f AS (SELECT pep_id, activity, sequence, " + ", ".join(
    f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in FEATURES) + " FROM described)"


def _gaps_sql(names: list[str]) -> str:
    return ", g AS (SELECT pep_id, " + ", ".join(
        f'CASE WHEN (pep_id + {i}) % 7 = 0 THEN NULL ELSE CAST("{c}" AS DOUBLE) END AS "{c}"' for i, c in enumerate(names)) + " FROM f)"


GAPS_SQL = FEATURE_SQL + _gaps_sql(FEATURES)


def feature_table(spark: SparkSession, sf_dir: str, names: list[str] = FEATURES) -> DataFrame:
    """Descriptors of the clean peptides as doubles, stored once because fitting reads them repeatedly."""
    table = with_descriptors(I.peptides(spark, sf_dir), "sequence", only=names)
    return materialize(
        table.select("pep_id", "activity", F.col("Sequence").alias("sequence"), *[F.col(c).cast("double").alias(c) for c in names]), "features"
    )


def _with_gaps(table: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    return table.select(
        "pep_id", *[F.when((F.col("pep_id") + i) % 7 != 0, F.col(c)).alias(c) for i, c in enumerate(names)]
    )


def _imputed(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    gaps = _with_gaps(feature_table(spark, sf_dir))
    return rounded(P.fill_missing(gaps, P.impute_values(gaps, FEATURES, strategy)))


def _fill_sql(expression: str) -> str:
    fills = ", ".join(f'{expression.format(c=c)} AS "m_{c}"' for c in FEATURES)
    values = ", ".join(f'round(coalesce("{c}", "m_{c}"), 6) + 0.0 AS "{c}"' for c in FEATURES)
    return f"{GAPS_SQL}, m AS (SELECT {fills} FROM g) SELECT pep_id, {values} FROM g, m"


@query(_fill_sql('median("{c}")'))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, "median")


@query(_fill_sql('avg("{c}")'))
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputed(spark, sf_dir, "mean")


_DISCRETE = ["Length", "AAC_A", "Motif_KK"]


@query(GAPS_SQL + " SELECT pep_id, " + ", ".join(
    f"""round(coalesce("{c}", (SELECT "{c}" FROM g WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC, "{c}" LIMIT 1)), 6) + 0.0 AS "{c}" """ for c in _DISCRETE) + " FROM g")
def impute_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _with_gaps(feature_table(spark, sf_dir)).select("pep_id", *_DISCRETE)
    return rounded(P.fill_missing(gaps, P.impute_values(gaps, _DISCRETE, "most_frequent")))


def _scaled(spark: SparkSession, sf_dir: str, scaler: str) -> DataFrame:
    table = feature_table(spark, sf_dir).select("pep_id", *FEATURES)
    return rounded(P.scale_columns(table, P.scaling(table, P.column_stats(table, FEATURES), FEATURES, scaler)))


def _scale_sql(centre: str, spread: str) -> str:
    stats = ", ".join(f'{centre.format(c=c)} AS "c_{c}", {spread.format(c=c)} AS "s_{c}"' for c in FEATURES)
    values = ", ".join(f'round(("{c}" - "c_{c}") / CASE WHEN "s_{c}" = 0 THEN 1 ELSE "s_{c}" END, 6) + 0.0 AS "{c}"' for c in FEATURES)
    return f"{FEATURE_SQL}, s AS (SELECT {stats} FROM f) SELECT pep_id, {values} FROM f, s"


@query(_scale_sql('avg("{c}")', 'stddev_pop("{c}")'))
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "standard")


@query(_scale_sql('min("{c}")', 'max("{c}") - min("{c}")'))
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "minmax")


@query(_scale_sql('median("{c}")', 'quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25)'))
def scale_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "robust")


@query(FEATURE_SQL + " SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "Descriptor", round(var_pop("{c}"), 4) AS variance FROM f""" for c in FEATURES) + ") WHERE variance > 0.05")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.column_stats(feature_table(spark, sf_dir), FEATURES)
    kept = P.varying_columns(stats, 0.05)
    return rounded(spark.createDataFrame([(c, stats[c].variance) for c in kept], "Descriptor string, variance double"), 4)


_LONG_SQL = FEATURE_SQL + ", long AS (" + " UNION ALL ".join(f"""SELECT pep_id, {i} AS place, '{c}' AS name, "{c}" AS v FROM f""" for i, c in enumerate(FEATURES)) + ")"
_PAIRS_SQL = _LONG_SQL + ", pairs AS (SELECT a.name AS feature_i, b.name AS feature_j, a.place AS i, b.place AS j, corr(a.v, b.v) AS r FROM long a JOIN long b USING (pep_id) GROUP BY ALL)"


@query(f"{_PAIRS_SQL} SELECT feature_i, feature_j, round(r, 6) + 0.0 AS corr FROM pairs")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DP.correlation_matrix(feature_table(spark, sf_dir), FEATURES))


def _gap_pairs_sql(names: list[str]) -> str:
    """Every pair over the rows where both are present; null, as a whole, where one does not vary over them."""
    long = " UNION ALL ".join(f"""SELECT pep_id, '{c}' AS name, "{c}" AS v FROM g""" for c in names)
    return f"""{_gaps_sql(names)}, long AS ({long}), met AS (SELECT a.name AS feature_i, b.name AS feature_j, a.v AS x, b.v AS y
         FROM long a JOIN long b USING (pep_id) WHERE a.v IS NOT NULL AND b.v IS NOT NULL)
       SELECT feature_i, feature_j, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) + 0.0 END AS corr FROM met GROUP BY ALL"""


@query(FEATURE_SQL + _gap_pairs_sql(FEATURES))
def corr_matrix_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DP.correlation_matrix(_with_gaps(feature_table(spark, sf_dir)), FEATURES))


WIDE = list(DESCRIPTOR_SQL)


@query(descriptor_cte(WIDE, PEP_SOURCE) + ", f AS (SELECT * FROM described)" + _gap_pairs_sql(WIDE))
def corr_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descriptors, each with gaps of its own, in one scan of the stored table."""
    return rounded(DP.correlation_matrix(_with_gaps(feature_table(spark, sf_dir, WIDE), WIDE), WIDE))


@query(f"""{_PAIRS_SQL} SELECT DISTINCT name AS "Feature" FROM long WHERE name NOT IN (SELECT feature_j FROM pairs WHERE i < j AND abs(r) > 0.9)""")
def corr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = P.uncorrelated_columns(feature_table(spark, sf_dir), FEATURES, 0.9)
    return spark.createDataFrame([(c,) for c in kept], "Feature string")


@query(f"""{_LONG_SQL} SELECT name AS "Descriptor", round(var_samp(v), 4) AS "Variance" FROM long GROUP BY name, place ORDER BY var_samp(v) DESC, place LIMIT 5""")
def top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DP.top_variance(feature_table(spark, sf_dir), FEATURES, 5), 4)


@query(f"""{_LONG_SQL} SELECT name AS "Descriptor", count(v) AS "Rows", round(min(v), 4) + 0.0 AS "Min", round(quantile_cont(v, 0.25), 4) + 0.0 AS "Q1", round(median(v), 4) + 0.0 AS "Median",
       round(quantile_cont(v, 0.75), 4) + 0.0 AS "Q3", round(max(v), 4) + 0.0 AS "Max", round(avg(v), 4) + 0.0 AS "Mean" FROM long GROUP BY name, place ORDER BY var_samp(v) DESC, place LIMIT 5""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DP.distribution_summary(feature_table(spark, sf_dir), FEATURES, 5), 4)


@query(f"""{_LONG_SQL} SELECT name AS "Feature", round(pow(corr(v, activity), 2) / (1 - pow(corr(v, activity), 2)) * (count(*) - 2), 6) + 0.0 AS "FScore" FROM long JOIN f USING (pep_id) GROUP BY name""")
def f_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SEL.score_table(spark, SEL.f_regression(feature_table(spark, sf_dir), FEATURES, "activity")))


@query(f"""{_LONG_SQL}, grouped AS (SELECT name, pep_id % 3 AS cls, count(*) AS n, avg(v) AS m, var_pop(v) AS vp FROM long GROUP BY name, pep_id % 3),
       overall AS (SELECT name, avg(v) AS gm FROM long GROUP BY name)
       SELECT name AS "Feature", round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))), 6) + 0.0 AS "FScore" FROM grouped JOIN overall USING (name) GROUP BY name""")
def f_classif(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_table(spark, sf_dir).withColumn("cls", F.col("pep_id") % 3)
    return rounded(SEL.score_table(spark, SEL.f_classif(table, FEATURES, "cls")))


_EDGES = ", ".join(f"quantile_cont(activity, {i / 5}) AS e{i}" for i in range(6))
_BIN = "CASE " + " ".join(f"WHEN activity <= e{i} THEN {i - 1}" for i in range(1, 6)) + " END"


@query(f"WITH {I.PEP_SQL}, e AS (SELECT {_EDGES} FROM pep) SELECT pep_id, CAST({_BIN} AS BIGINT) AS bin FROM pep, e")
def regression_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pep = I.peptides(spark, sf_dir)
    return rounded(pep.select("pep_id", SP.regression_bins(pep, "activity").alias("bin")))


def _split_sql(rows_sql: str, id_col: str) -> str:
    """Exact proportional cuts per stratum, left-over rows to the largest remainders."""
    return f"""WITH {rows_sql},
  sizes AS (SELECT s, count(*) AS n FROM r GROUP BY s), t1 AS (SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS total FROM sizes),
  a1 AS (SELECT s, n, n * total // rows + CASE WHEN row_number() OVER (ORDER BY n * total % rows DESC, s) <= total - sum(n * total // rows) OVER () THEN 1 ELSE 0 END AS test FROM sizes, t1),
  t2 AS (SELECT CAST(sum(n - test) AS BIGINT) AS rows, CAST(ceil(sum(n - test) * (0.1 / (1.0 - 0.2))) AS BIGINT) AS total FROM a1),
  a2 AS (SELECT s, test, (n - test) * total // rows + CASE WHEN row_number() OVER (ORDER BY (n - test) * total % rows DESC, s) <= total - sum((n - test) * total // rows) OVER () THEN 1 ELSE 0 END AS val FROM a1, t2),
  placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(CAST({id_col} AS VARCHAR) || ':42'), {id_col}) AS rn FROM r)
  SELECT {id_col}, s AS stratum, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val THEN 'val' ELSE 'train' END AS split FROM placed JOIN a2 USING (s)"""


@query(_split_sql("r AS (SELECT o_orderkey, o_orderpriority AS s FROM orders)", "o_orderkey"))
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    return SP.with_split(orders, "o_orderkey", "stratum", "multiclass")


def _cut_sql(rows: str, name: str, share: str) -> str:
    """Rows of a table cut into `taken` and the rest, by target bins of that table."""
    return f"""{name}_e AS (SELECT {_EDGES} FROM {rows}), {name}_r AS (SELECT pep_id, activity, CAST({_BIN} AS VARCHAR) AS s FROM {rows}, {name}_e),
  {name}_n AS (SELECT s, count(*) AS n FROM {name}_r GROUP BY s), {name}_t AS (SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(ceil(sum(n) * ({share})) AS BIGINT) AS total FROM {name}_n),
  {name}_a AS (SELECT s, n * total // rows + CASE WHEN row_number() OVER (ORDER BY n * total % rows DESC, s) <= total - sum(n * total // rows) OVER () THEN 1 ELSE 0 END AS cut FROM {name}_n, {name}_t),
  {name} AS (SELECT pep_id, activity, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(pep_id AS VARCHAR) || ':42'), pep_id) <= cut AS taken FROM {name}_r JOIN {name}_a USING (s))"""


@query(f"""WITH {I.PEP_SQL}, {_cut_sql("pep", "first_cut", "0.2")}, left_over AS (SELECT pep_id, activity FROM first_cut WHERE NOT taken),
  {_cut_sql("left_over", "second_cut", "0.1 / (1.0 - 0.2)")}
  SELECT pep_id, 'test' AS split FROM first_cut WHERE taken UNION ALL SELECT pep_id, CASE WHEN taken THEN 'val' ELSE 'train' END FROM second_cut""")
def split_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pep = I.peptides(spark, sf_dir)
    return SP.with_split(pep, "pep_id", "activity", "regression").select("pep_id", "split")


@query(f"""WITH {I.PEP_SQL} SELECT pep_id, CAST(rep AS BIGINT) AS repeat, CAST((row_number() OVER (PARTITION BY rep ORDER BY md5(CAST(pep_id AS VARCHAR) || ':' || rep || ':42'), pep_id) - 1) % 5 AS BIGINT) AS fold
       FROM pep, (SELECT unnest(range(0, 5)) AS rep)""")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SP.cv_folds(I.peptides(spark, sf_dir), "pep_id", 5, repeats=SP.REPEATS))


@query("""SELECT o_orderkey, CAST(0 AS BIGINT) AS repeat, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':0:42'), o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM orders""")
def cv_folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SP.cv_folds(I.table(spark, sf_dir, "orders"), "o_orderkey", 5, label="o_orderpriority"))


@query(f"WITH {I.PEP_SQL} SELECT pep_id FROM pep ORDER BY md5(CAST(pep_id AS VARCHAR)), pep_id LIMIT 300")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.sample_rows(I.peptides(spark, sf_dir), "pep_id", 300).select("pep_id")


NEAR = ["Gravy", "NetCharge_pH7", "HydrophobicMoment100"]
_NEAR_SQL = descriptor_cte(NEAR, PEP_SOURCE) + """, q AS (SELECT * FROM described WHERE pep_id % 5 = 0), t AS (SELECT * FROM described WHERE pep_id % 5 <> 0),
  near AS (SELECT q.pep_id AS query_id, t.pep_id AS train_id, t.activity AS y, sqrt(""" + " + ".join(f'pow(q."{c}" - t."{c}", 2)' for c in NEAR) + """) AS d FROM q, t
           QUALIFY row_number() OVER (PARTITION BY q.pep_id ORDER BY d, t.pep_id) <= 5)"""


def _neighbors(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    table = feature_table(spark, sf_dir, NEAR)
    asked, known = table.filter(F.col("pep_id") % 5 == 0), table.filter(F.col("pep_id") % 5 != 0)
    return NN.nearest_neighbors(asked, known, "pep_id", "pep_id", NEAR, "activity", **options)


@query(f"{_NEAR_SQL} SELECT query_id, train_id, round(d, 6) + 0.0 AS distance FROM near")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_neighbors(spark, sf_dir).drop("y"))


@query(f"{_NEAR_SQL} SELECT query_id, train_id, round(d, 6) + 0.0 AS distance FROM near")
def knn_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for reference tables too large to broadcast, forced by a limit of zero bytes."""
    return rounded(_neighbors(spark, sf_dir, broadcast_bytes=0).drop("y"))


#: All descriptors that SQL can say.
WIDE = list(DESCRIPTOR_SQL)


@query(descriptor_cte(WIDE, PEP_SOURCE) + """, q AS (SELECT * FROM described WHERE pep_id % 5 = 0), t AS (SELECT * FROM described WHERE pep_id % 5 <> 0),
  near AS (SELECT q.pep_id AS query_id, t.pep_id AS train_id, sqrt(""" + " + ".join(f'pow(q."{c}" - t."{c}", 2)' for c in WIDE) + """) AS d FROM q, t
           QUALIFY row_number() OVER (PARTITION BY q.pep_id ORDER BY d, t.pep_id) <= 5)
  SELECT query_id, train_id, round(d, 6) + 0.0 AS distance FROM near""")
def knn_join_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the full width of descriptors, by the way for large reference tables."""
    table = feature_table(spark, sf_dir, WIDE)
    asked, known = table.filter(F.col("pep_id") % 5 == 0), table.filter(F.col("pep_id") % 5 != 0)
    return rounded(NN.nearest_neighbors(asked, known, "pep_id", "pep_id", WIDE, "activity", broadcast_bytes=0).drop("y"))


@query(f"{_NEAR_SQL} SELECT query_id, round(avg(y), 6) AS prediction FROM near GROUP BY query_id")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(NN.neighbor_regression(_neighbors(spark, sf_dir)))


@query(f"""{_NEAR_SQL}, votes AS (SELECT query_id, train_id % 3 AS cls, count(*) / 5.0 AS share FROM near GROUP BY ALL)
       SELECT query_id, CAST(arg_max(cls, share * 100 - cls) AS DOUBLE) AS prediction, round(max(share), 6) + 0.0 AS share FROM votes GROUP BY query_id""")
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_table(spark, sf_dir, NEAR).withColumn("cls", F.col("pep_id") % 3)
    asked, known = table.filter(F.col("pep_id") % 5 == 0), table.filter(F.col("pep_id") % 5 != 0)
    found = NN.neighbor_classes(NN.nearest_neighbors(asked, known, "pep_id", "pep_id", NEAR, "cls"), 3)
    return rounded(found.select("query_id", "prediction", F.array_max("probability").alias("share")))


@query()
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PCA.pca_analysis(feature_table(spark, sf_dir), FEATURES, n_components=8).explained_variance


@query()
def pca_loadings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PCA.top_loadings(PCA.pca_analysis(feature_table(spark, sf_dir), FEATURES, n_components=8).loadings)


@query()
def pca_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PCA.embedding(feature_table(spark, sf_dir), FEATURES, ["pep_id"])
