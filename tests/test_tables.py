import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import design as D
from residua.operators import metrics as M
from residua.operators import scoring as R
from residua.operators import screening as C
from residua.operators import user_scales as U
from residua.operators import validation as V
from residua.operators.ordering import with_row_number, with_running_total
from residua.operators.quantiles import exact_quantiles
from tests.conftest import peptide


def test_three_way_validation(spark):
    rows = [(1, " ak l"), (2, "AKL"), (3, "AKLB*B"), (4, None), (5, "  "), (6, "GIGA"), (7, "akl")]
    found = V.validate_sequences(spark.createDataFrame(rows, "row_id int, Sequence string"))
    assert sorted((r["row_id"], r["Sequence"]) for r in found.valid.collect()) == [(1, "AKL"), (6, "GIGA")]
    assert [(r["row_id"], r["InvalidCharacters"]) for r in found.invalid.collect()] == [(3, "*B")]
    assert [r["row_id"] for r in found.duplicates.collect()] == [1, 2, 7]
    assert found.counts.first().asDict() == {"valid_unique": 2, "invalid_rows": 1, "duplicate_rows": 3}


def test_duplicates_of_a_hot_sequence_stay_whole(spark):
    rows = [(i, "AAAA" if i % 3 == 0 else peptide(i // 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id int, Sequence string").repartition(7)
    counts = {}
    for _, s in rows:
        counts[s] = counts.get(s, 0) + 1
    expected = sorted(((s, i) for i, s in rows if counts[s] > 1))
    assert [(r["Sequence"], r["row_id"]) for r in V.duplicate_rows(df, "Sequence", ["row_id"]).collect()] == expected


def test_union_and_names(spark):
    up = spark.createDataFrame([("AAA", 1.0)], "pep string, Activity double")
    manual = spark.createDataFrame([("Manual_1", "KKK")], "Name string, Sequence string")
    rows = V.union_sources(up, manual, "pep").orderBy("source").collect()
    assert [(r["Sequence"], r["Name"], r["Activity"]) for r in rows] == [("AAA", None, 1.0), ("KKK", "Manual_1", None)]
    named = V.with_default_names(up, [F.col("pep")])
    assert named.first()["Name"] == "Peptide_1"
    with pytest.raises(ValueError):
        V.union_sources(None, None)


def test_sequence_column_detection(spark):
    def guess(names, rows):
        return V.guess_sequence_column(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))

    assert guess(["x", "AA Sequence"], [("a", "b")]) == "AA Sequence"
    assert guess(["seq", "Sequence"], [("a", "b")]) == "Sequence"
    assert guess(["note", "my_pep_seq"], [("a", "b")]) == "my_pep_seq"
    assert guess(["a", "b"], [("12", "akl"), ("34", "GIGA"), ("5", "B2")]) == "b"
    assert guess(["a", "b"], [("12", "akl"), ("34", "B2"), (None, None)]) is None


def test_numeric_targets_and_alignment(spark):
    df = spark.createDataFrame([("1", "x", 1.0, 2.0), ("2", "y", None, 3.0), ("3", "z", 3.0, 4.0)], "A string, Name string, B double, Gravy double")
    assert V.numeric_targets(df, ["Gravy"]) == ["A"]
    row = V.align_columns(df, ["Name"], ["A", "Missing"]).orderBy("Name").first()
    assert (row["A"], row["Missing"]) == (1.0, 0.0)


@pytest.mark.parametrize("hot", [False, True])
def test_row_numbers_match_a_sort(spark, hot):
    rng = random.Random(3)
    rows = [(i, "a" if hot and i % 3 else rng.choice("abcd"), rng.choice([None, 1.0, 2.0, 2.0, 5.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(5)
    out = with_row_number(df, [F.col("v").desc_nulls_last(), F.col("id")], "n", ["g"]).collect()
    expected = {}
    for g in "abcd":
        group = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        expected |= {r[0]: k + 1 for k, r in enumerate(group)}
    assert {r["id"]: r["n"] for r in out} == expected
    overall = with_row_number(df, [F.col("v").asc(), F.col("id")], "n").collect()
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert {r["id"]: r["n"] for r in overall} == {r[0]: k + 1 for k, r in enumerate(order)}


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    assert {r["id"]: r["n"] for r in with_row_number(df, [F.col("id")], "n", ["g"]).collect()} == {1: 1, 2: 2, 3: 1}


def test_running_total(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 7).repartition(6)
    out = {r["id"]: r["t"] for r in with_running_total(df, [F.col("id")], "w", "t").collect()}
    assert out == dict(enumerate(itertools.accumulate(i % 7 for i in range(1000))))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    table = {
        "flat": np.full(30000, 2.5), "hot": np.where(rng.random(30000) < 0.4, 1.0, rng.normal(size=30000)),
        "wide": rng.lognormal(0, 8, 30000), "few": rng.integers(0, 3, 30000).astype(float),
    }
    rows = [tuple(float(table[c][i]) if (i + len(c)) % 11 else None for c in table) for i in range(30000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in table)).repartition(6)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = exact_quantiles(df, list(table), probabilities)
    for k, c in enumerate(table):
        present = [r[k] for r in rows if r[k] is not None]
        assert found[c].count == len(present)
        for p in probabilities:
            assert found[c].values[p] == pytest.approx(np.quantile(present, p), rel=1e-12, abs=1e-15)
    empty = exact_quantiles(spark.createDataFrame([(None,)], "v double"), ["v"], [0.5])["v"]
    assert empty.count == 0 and empty.values[0.5] is None


def test_scores_of_special_batches(spark):
    def scored(values, target):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, Prediction double")
        return [r.asDict() for r in R.with_regression_scores(df, target).orderBy("i").collect()]

    assert scored([-3.0], "IC50")[0]["Prediction"] == 3.0
    assert scored([4.0], "IC50")[0]["Prediction"] == 20.0
    assert [r["RankingScore"] for r in scored([2.0, 2.0], "MIC")] == [pytest.approx(100 / 3)] * 2
    low = scored([1.0, 3.0, None, float("nan"), 2.0], "docking_score")
    assert [r["RankingScore"] for r in low] == [100.0, 0.0, None, None, 50.0]
    assert [r["RawModelPrediction"] for r in low] == [1.0, 3.0, None, None, 2.0]
    high = scored([1.0, 3.0, 2.0], "Activity")
    assert [r["NormalizedScore_0_100"] for r in high] == [0.0, 100.0, 50.0]
    assert scored([5.0, 5.0], "Activity")[0]["NormalizedScore_0_100"] == 100.0


def test_rank_is_dense_and_missing_scores_come_last(spark):
    values = [3.0, None, 7.0, float("nan"), 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id int, RankingScore double")
    ranks = {r["row_id"]: r["Rank"] for r in R.with_rank(df, ["row_id"]).collect()}
    assert ranks == {2: 1, 0: 2, 4: 3, 1: 4, 3: 5}


def test_class_scores(spark):
    df = spark.createDataFrame([([0.3, 0.7],)], "probability array<double>")
    assert R.with_class_scores(df, ["no", "yes"]).first().asDict() == {"Prob_no": 0.3, "Prob_yes": 0.7, "RankingScore": 0.7}
    three = spark.createDataFrame([([0.3, 0.2, 0.5],)], "probability array<double>")
    assert R.with_class_scores(three, list("abc")).first()["RankingScore"] == 0.5


def test_regression_metrics_edge_cases(spark):
    def metrics(rows):
        return M.regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()

    assert metrics([(2.0, 2.0), (2.0, 2.0)])["R2"] == 1.0 and metrics([(2.0, 2.0), (2.0, 3.0)])["R2"] == 0.0
    row = metrics([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)])
    assert row["R2"] == pytest.approx(1 - 1.25 / (14 / 3)) and row["RMSE"] == pytest.approx(math.sqrt(1.25 / 3)) and row["MAE"] == 0.5


def test_auc_matches_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 9) / 10) for _ in range(300)]
    wins = [(1.0 if p > q else 0.5 if p == q else 0.0) for a, p in rows if a == "b" for b, q in rows if b == "a"]
    found = M.roc_auc(spark.createDataFrame(rows, "y string, s double"), "y", "s").first()["ROC_AUC"]
    assert found == pytest.approx(sum(wins) / len(wins))
    one = spark.createDataFrame([("a", 0.5), ("a", 0.1)], "y string, s double")
    assert M.roc_auc(one, "y", "s").first()["ROC_AUC"] is None


def test_classification_tables(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    assert M.classification_metrics(df, "y", "p").first()["Accuracy"] == 0.5
    matrix = [tuple(r)[1:] for r in M.confusion_matrix(df, "y", "p", ["a", "b", "c", "d"]).collect()]
    assert matrix == [("a", 1, 1, 0, 0), ("b", 0, 1, 0, 0), ("c", 1, 0, 0, 0), ("d", 0, 0, 0, 0)]
    report = {r["label"]: r for r in M.classification_report(df, "y", "p", ["a", "b", "c"]).collect()}
    assert report["c"]["precision"] == 0.0 and report["a"]["recall"] == 0.5 and report["weighted avg"]["support"] == 4


def test_screening_windows(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (2, 50, None)], "id int, Length int, Gravy double")
    rows = C.with_screening(df).orderBy("id").collect()
    assert [(r["Pass_Length"], r["Pass_Gravy"], r["CriteriaTotal"], r["StructureAssessment"]) for r in rows] == [
        (1, 1, 2, "Excellent"), (0, 0, 2, "Needs Optimization")]
    none = C.with_screening(spark.createDataFrame([(1,)], "id int")).first()
    assert none["StructureQualityScore"] is None and none["StructureAssessment"] == "Insufficient descriptor coverage"
    custom = C.with_screening(df, {"Length": (40, 60)}).orderBy("id").collect()
    assert [r["StructureQualityScore"] for r in custom] == [0.0, 100.0]


def test_screening_join_matches_missing_names(spark):
    predictions = spark.createDataFrame([(1, None, "AAA"), (2, "x", "KKK")], "Rank int, Name string, Sequence string")
    screened = C.with_screening(spark.createDataFrame([(None, "AAA", 10)], "Name string, Sequence string, Length int"))
    rows = {r["Rank"]: r["StructureQualityScore"] for r in C.join_screening(predictions, screened).collect()}
    assert rows == {1: 100.0, 2: None}


def test_position_effects_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(peptide(i, rng.randint(1, 6)), rng.uniform(0, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "Sequence string, Activity double")
    y = np.array([t for _, t in rows])
    found = {(r["Position"], r["Residue"]): r for r in D.position_effects(df, "Sequence", "Activity").collect()}
    expected = 0
    for pos in range(6):
        for aa in "ACDEFGHIKLMNPQRSTVWY":
            mask = np.array([len(s) > pos and s[pos] == aa for s, _ in rows])
            if mask.sum() < 2:
                continue
            expected += 1
            row = found[(pos + 1, aa)]
            assert row["Count"] == mask.sum() and row["MeanTarget"] == pytest.approx(y[mask].mean())
            assert row["Correlation"] == pytest.approx(np.corrcoef(mask.astype(float), y)[0, 1], abs=1e-9)
    assert len(found) == expected


def test_no_correlation_without_variation(spark):
    df = spark.createDataFrame([("AK", 0.1), ("AR", 0.1), ("AK", 0.1)], "s string, t double")
    rows = D.position_effects(df, "s", "t", "maximize").collect()
    assert rows and all(r["Correlation"] is None for r in rows)


def test_mutations_and_summaries(spark):
    recs = spark.createDataFrame(
        [(p, "K", 3, 0.1, "text") for p in range(1, 20)],
        "Position int, RecommendedResidue string, EvidenceCount int, RecommendedCorrelation double, Suggestion string")
    rows = D.suggest_mutations(spark.createDataFrame([("akA" + "A" * 20,)], "Sequence string"), recs, top_n=12).orderBy("Position").collect()
    assert len(rows) == 12 and rows[1]["Action"] == "Keep" and rows[0]["SuggestedSequence"] == "KKA" + "A" * 20
    pairs = [("AKL", "AKL", "Reference"), ("AKL", "ARLV", "K2R, +1 residue(s)"), ("AKL", "A", "-2 residue(s)"),
             ("A" * 14, "K" * 14, ", ".join(f"A{i}K" for i in range(1, 13)) + " ...")]
    df = spark.createDataFrame([(a, b, e) for a, b, e in pairs], "a string, b string, e string")
    for r in df.select(D.mutation_summary(F.col("a"), F.col("b")).alias("m"), "e").collect():
        assert r["m"] == r["e"]


def test_alignment_uses_the_first_best_peptide(spark):
    rows = [(2, "b", "AKLV", 5.0), (1, "a", "AKLR", 5.0), (3, "c", "GGGG", None), (4, "d", " ", 9.0)]
    df = spark.createDataFrame(rows, "row_id int, Name string, Sequence string, Activity double")
    out = D.sort_alignment(D.alignment_to_reference(df, "Sequence", "Activity", ["row_id"]), ["row_id"]).collect()
    assert [r["Name"] for r in out] == ["a", "b", "c"] and {r["ReferenceName"] for r in out} == {"a"}
    assert out[1]["EditSimilarityToReference"] == 0.75 and out[2]["Target"] is None


def test_scales_and_screens_from_tables(spark, monkeypatch):
    scales = spark.createDataFrame(
        [("a", "A", 1.0), ("a", "k", 2.0), ("a", "K", 3.0), ("b", "A", -1.0), (None, "A", 1.0), ("c", None, 2.0), ("b", "K", None)], "scale string, residue string, value double"
    )
    df = spark.createDataFrame([(1, "AK A", "x"), (2, None, "y"), (3, "aaa", "z"), (3, "W", "z")], "id int, Sequence string, scale string").drop("scale")
    expected = {(1, "a", 5.0, 5 / 3), (1, "b", None, None), (2, "a", 0.0, None), (2, "b", 0.0, None), (3, "a", 3.0, 1.0), (3, "b", -3.0, -1.0), (3, "a", None, None), (3, "b", None, None)}
    assert {tuple(r) for r in U.scale_sums(df, ["id"], scales).collect()} == expected
    monkeypatch.setattr(U, "BROADCAST_ROWS", 1)  # more scales than are broadcast at once
    assert {tuple(r) for r in U.scale_sums(df, ["id"], scales).collect()} == expected and U.scale_sums(df, ["id"], scales).count() == 8
    U.register_sql(spark, scales, "my_scales")
    got = spark.sql("SELECT scale, scale_sum('AKA', residue_values) AS t, scale_mean('', residue_values) AS m FROM my_scales").collect()
    assert {tuple(r) for r in got} == {("a", 5.0, None), ("b", None, None)}

    criteria = spark.createDataFrame(
        [("one", "x", 0.0, 1.0), ("one", "x", 2.0, None), ("one", "y", None, 5.0), ("one", "absent", 0.0, 1.0), ("two", "absent", 0.0, 1.0), ("one", None, 0.0, 1.0)],
        "screen string, criterion string, low double, high double",
    )
    table = spark.createDataFrame([(1, "0.5", 4.0, "s"), (2, "9", None, "s"), (3, "bad", 6.0, "s")], "id int, x string, y double, screen string").drop("screen")
    got = {r["id"]: tuple(r)[1:] for r in U.screen_by_table(table, ["id"], criteria).collect()}
    assert got == {1: ("one", 2, 3, pytest.approx(200 / 3), "Moderate"), 2: ("one", 1, 3, pytest.approx(100 / 3), "Needs Optimization"), 3: ("one", 0, 3, 0.0, "Needs Optimization")}
    assert U.screen_by_table(table, ["id"], criteria.where("screen = 'two'")).count() == 0 and U.scale_sums(df.where("id > 9"), ["id"], scales).count() == 0
