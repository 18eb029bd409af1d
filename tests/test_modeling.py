import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from residua.functions.descriptors import DescriptorConfig, with_descriptors
from residua.operators import neighbors as NN
from residua.operators import preprocessing as P
from residua.operators import selection as SEL
from residua.operators import splitting as SP
from residua.operators.decomposition import pca_analysis, top_loadings
from residua.operators.storage import materialize
from residua.plans import explanation as E
from residua.plans import class_folds
from residua.plans import training as T
from residua.plans.bundle import ModelBundle
from residua.plans.prediction import predict_table
from tests.conftest import peptide

CONFIG = DescriptorConfig(include_fingerprints=False, include_elemental=False)


@pytest.fixture(scope="module")
def assay(spark):
    rows = [(i, f"Pep_{i}", peptide(i, 6 + i % 9)) for i in range(240)]
    df = with_descriptors(spark.createDataFrame(rows, "row_id bigint, Name string, Sequence string"), config=CONFIG)
    noise = F.col("row_id") * 37 % 11 / 11.0
    return materialize(df.withColumns({
        "Potency": F.col("Gravy") * 3.0 + noise,
        "IC50": F.col("NetCharge_pH7") + 8.0 + noise,
        "Group": F.when(F.col("Gravy") + noise > 0.2, "active").otherwise("inactive"),
        "Level": F.when(F.col("NetCharge_pH7") > 0.5, "high").when(F.col("NetCharge_pH7") > -0.5, "mid").otherwise("low"),
    }))


def _frame(spark, matrix, names):
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in matrix], ", ".join(f"{n} double" for n in names))


def test_preprocessor_matches_numpy_and_survives_its_state(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    x[:, 1] = x[:, 0] * 2 + rng.normal(scale=0.01, size=400)
    x[:, 3] = 4.0
    x[::7, 2] = np.nan
    names = ["a", "b", "c", "flat", "e"]
    df = _frame(spark, x, names).withColumn("gone", F.lit(None).cast("double"))
    fitted = P.fit_preprocessor(df, [*names, "gone"])
    assert fitted.kept == ["a", "c", "e"]
    filled = np.where(np.isnan(x[:, 2]), np.nanmedian(x[:, 2]), x[:, 2])
    expected = (filled - filled.mean()) / filled.std()
    again = P.FittedPreprocessor.from_state(fitted.state())
    got = np.array([r["v"] for r in again.transform(df, []).select(vector_to_array("features").alias("v")).collect()])
    assert np.allclose(np.sort(got[:, 1]), np.sort(expected))


@pytest.mark.parametrize("scaler", ["minmax", "robust", "none"])
def test_scalers(spark, scaler):
    x = np.random.default_rng(2).normal(size=(101, 2))
    df = _frame(spark, x, ["a", "b"])
    pairs = P.scaling(df, P.column_stats(df, ["a", "b"]), ["a", "b"], scaler)
    low, q1, mid, q3, high = np.quantile(x[:, 0], [0, 0.25, 0.5, 0.75, 1])
    expected = {"minmax": (low, high - low), "robust": (mid, q3 - q1), "none": (0.0, 1.0)}[scaler]
    assert pairs["a"] == pytest.approx(expected)


def test_small_wide_regressions_are_stabilized():
    wide = P.stabilized(P.PreprocessingConfig(), "regression", 465, 100)
    assert wide.use_pca and wide.pca_components == 25 and wide.correlation_threshold == 0.90
    assert P.stabilized(P.PreprocessingConfig(), "regression", 65, 100) == P.PreprocessingConfig()


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=(200, 4)) @ np.random.default_rng(4).normal(size=(4, 4))
    found = pca_analysis(_frame(spark, x, list("abcd")), list("abcd"), n_components=3)
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    rows = found.explained_variance.orderBy("Component").collect()
    assert [r["ExplainedVarianceRatio"] for r in rows] == pytest.approx(list(values[:3] / values.sum()))
    assert rows[2]["CumulativeVarianceRatio"] == pytest.approx(values[:3].sum() / values.sum())
    assert found.scores.count() == 200 and top_loadings(found.loadings, "PC1", 2).count() == 2


def test_selection_rules(spark):
    assert SEL.selection_percentile(40, 5) == 100 and SEL.selection_percentile(400, 100) == 20
    assert SEL.select_percentile({"a": 1.0, "b": 9.0, "c": 9.0, "d": 0.0}, 50) == ["b", "c"]
    x = np.random.default_rng(5).normal(size=(300, 2))
    y = x[:, 0] + np.random.default_rng(6).normal(size=300)
    scores = SEL.f_regression(_frame(spark, np.column_stack([x, np.ones(300), y]), ["a", "b", "flat", "y"]), ["a", "b", "flat"], "y")
    r = np.corrcoef(x[:, 0], y)[0, 1]
    assert scores["a"] == pytest.approx(r * r / (1 - r * r) * 298) and scores["flat"] == 0.0


def test_split_and_folds_have_exact_sizes(spark):
    rows = [(i, "rare" if i % 50 == 0 else "a" if i % 3 else "b", float(i % 97)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, c string, y double")
    sizes = {(r["c"], r["split"]): r["count"] for r in SP.with_split(df, "id", "c", "multiclass").groupBy("c", "split").count().collect()}
    assert sum(v for (c, s), v in sizes.items() if s == "test") == 100 and sizes[("rare", "test")] == 2
    assert sum(v for (c, s), v in sizes.items() if s == "val") == 50
    again = SP.with_split(df.repartition(3), "id", "c", "multiclass").exceptAll(SP.with_split(df, "id", "c", "multiclass"))
    assert again.count() == 0
    dealt = SP.cv_folds(df, "id", 4, "c").join(df, "id").groupBy("c", "fold").count().collect()
    for label in ("rare", "a", "b"):
        counts = [r["count"] for r in dealt if r["c"] == label]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1
    assert SP.fold_count("binary", 5, 500, 1) is None and SP.fold_count("regression", 5, 6) == 3
    assert SP.regression_bins(df.limit(11), "y") is None
    assert SP.regression_bins(df.withColumn("y", F.lit(1.0)), "y") is None


@pytest.mark.parametrize("limit", [NN.BROADCAST_BYTES, 0])
def test_neighbours_match_brute_force_with_hot_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(NN, "BLOCK_ROWS", 60)
    monkeypatch.setattr(NN, "GROUP_QUERIES", 20)
    rng = np.random.default_rng(7)
    train = np.round(rng.normal(size=(500, 3)), 1)
    train[:170] = train[0]
    asked = np.vstack([np.round(rng.normal(size=(60, 3)), 1), train[:20]])
    t = spark.createDataFrame([(i, *map(float, v), float(i % 5)) for i, v in enumerate(train)], "id bigint, a double, b double, c double, y double")
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(asked)], "id bigint, a double, b double, c double")
    rows = NN.nearest_neighbors(q, t, "id", "id", ["a", "b", "c"], "y", 5, broadcast_bytes=limit).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["distance"], r["train_id"])):
        got.setdefault(r["query_id"], []).append(r["train_id"])
    for i, v in enumerate(asked):
        d = np.sqrt(((train - v) ** 2).sum(1))
        assert got[i] == sorted(range(500), key=lambda j: (d[j], j))[:5]


def test_neighbours_over_columns_that_rule_out_nothing(spark, monkeypatch):
    monkeypatch.setattr(NN, "BLOCK_ROWS", 20)
    monkeypatch.setattr(NN, "MOST_VISITS", 30)
    rng = np.random.default_rng(9)
    train, asked = rng.normal(size=(600, 40)), rng.normal(size=(30, 40))
    t = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(train)], "id bigint, v array<double>, y double")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id bigint, v array<double>")
    got = {}
    for r in sorted(NN.nearest_neighbors(q, t, "id", "id", "v", "y", 5, broadcast_bytes=0).collect(), key=lambda r: (r["query_id"], r["distance"], r["train_id"])):
        got.setdefault(r["query_id"], []).append((r["train_id"], r["y"]))
    for i, v in enumerate(asked):
        d = np.sqrt(((train - v) ** 2).sum(1))
        assert got[i] == [(j, float(j % 5)) for j in sorted(range(600), key=lambda j: (d[j], j))[:5]]


def test_linear_folds_agree_with_fitted_models(spark, assay, monkeypatch):
    fast = T.train_and_compare(assay, "Potency", "regression", ["Ridge", "Lasso"], "row_id", CONFIG, refit=False, folds=3)
    monkeypatch.setattr(T, "PENALTIES", {})
    slow = T.train_and_compare(assay, "Potency", "regression", ["Ridge", "Lasso"], "row_id", CONFIG, refit=False, folds=3)
    for a, b in zip(fast.comparison.collect(), slow.comparison.collect()):
        assert a["Model"] == b["Model"] and a["R2"] == pytest.approx(b["R2"])
        assert a["CV_r2_mean"] == pytest.approx(b["CV_r2_mean"], abs=1e-4)
    assert fast.outputs["Ridge"].folds.count() == 15 and fast.rows == 240


FAST = {"Random Forest": {"numTrees": 5, "maxDepth": 5}, "Extra Trees": {"numTrees": 5, "maxDepth": 5},
        "Gradient Boosting": {"maxIter": 3}, "MLP Classifier": {"maxIter": 5}, "SVM (RBF)": {"dimensions": 16}, "SVR (RBF)": {"dimensions": 16, "maxIter": 8}}


def test_every_regression_model_trains_saves_and_scores(spark, assay, tmp_path):
    names = ["Elastic Net", "Random Forest", "SVR (RBF)", "Gradient Boosting", "Extra Trees", "kNN"]
    result = T.train_and_compare(assay, "IC50", "regression", names, "row_id", CONFIG, folds=None, options=FAST)
    rows = {r["Model"]: r for r in result.comparison.collect()}
    assert set(rows) == set(names) and rows["Elastic Net"]["R2"] > 0.5 and result.best_model in names
    new = spark.createDataFrame([(i, f"N{i}", peptide(1000 + i, 8)) for i in range(20)], "row_id bigint, Name string, Sequence string")
    for name in ("SVR (RBF)", "kNN"):
        bundle = result.outputs[name].bundle
        path = str(tmp_path / name.split()[0])
        bundle.save(spark, path)
        before = predict_table(bundle, new).predictions
        after = predict_table(ModelBundle.load(spark, path), new).predictions
        key = ["Rank", "row_id"]
        assert before.select(*key).exceptAll(after.select(*key)).count() == 0
        first = after.orderBy("Rank").first()
        assert first["Rank"] == 1 and first["OptimizationDirection"] == "minimize" and first["RankingScore"] == 100.0
        assert "StructureAssessment" in after.columns and after.count() == 20
    with pytest.raises(TypeError):
        spark.createDataFrame([("other", "{}")], "kind string, content string").write.parquet(str(tmp_path / "bad" / "metadata"))
        ModelBundle.load(spark, str(tmp_path / "bad"))


def test_every_classifier_trains(spark, assay):
    names = ["Logistic Regression", "Random Forest", "SVM (RBF)", "Gradient Boosting", "Extra Trees", "kNN", "Naive Bayes", "MLP Classifier"]
    result = T.train_and_compare(assay, "Level", "multiclass", names, "row_id", CONFIG, folds=None, options=FAST)
    rows = {r["Model"]: r for r in result.comparison.collect()}
    assert set(rows) == set(names) and rows["Logistic Regression"]["Accuracy"] > 0.6
    boosted = result.outputs["Gradient Boosting"].bundle
    scored = predict_table(boosted, assay.select("row_id", "Sequence")).predictions.first()
    assert scored["Prediction"] in ("high", "low", "mid")
    assert scored["Prob_high"] + scored["Prob_low"] + scored["Prob_mid"] == pytest.approx(1.0)


def test_binary_classes_importance_and_attribution(spark, assay):
    names = ["Logistic Regression", "Random Forest"]
    result = T.train_and_compare(assay, "Group", "binary", names, "row_id", CONFIG, folds=2, options=FAST, parallelism=8)
    assert all(r["ROC_AUC"] > 0.7 for r in result.comparison.collect())
    for name in names:
        bundle = result.outputs[name].bundle
        importance = E.native_importance(bundle, spark)
        assert importance.count() == len(bundle.feature_names)
        table = E.attribution(bundle, assay, "row_id")
        assert table.count() == len(bundle.feature_names) and table.first()["MeanAbsAttribution"] > 0
    assert E.top_features(importance, 3).count() == 3
    with pytest.raises(ValueError):
        T.train_and_compare(assay, "Level", "binary", names, "row_id", CONFIG)


def test_linear_attribution_is_coefficient_times_distance(spark, assay):
    bundle = T.train_and_compare(assay, "Potency", "regression", ["Ridge"], "row_id", CONFIG, folds=2).outputs["Ridge"].bundle
    x = np.array([r["v"] for r in bundle.features(assay, ["row_id"]).select(vector_to_array("features").alias("v")).collect()])
    weights = np.array(bundle.model.weights()) * bundle.target_scale
    expected = dict(zip(bundle.feature_names, np.abs((x - x.mean(0)) * weights).mean(0)))
    for r in E.attribution(bundle, assay, "row_id").collect():
        assert r["MeanAbsAttribution"] == pytest.approx(expected[r["Feature"]])


def test_feature_selection_and_projection_in_training(spark, assay):
    small = assay.filter("row_id < 15")
    result = T.train_and_compare(small, "Potency", "regression", ["Ridge"], "row_id", CONFIG, folds=2,
                                 preprocessing=P.PreprocessingConfig(correlation_threshold=1.0, scaler="minmax"))
    bundle = result.outputs["Ridge"].bundle
    assert bundle.model.selected is None or len(bundle.feature_names) == len(bundle.model.selected)
    projected = T.train_and_compare(assay, "Potency", "regression", ["Ridge"], "row_id", CONFIG, folds=2,
                                    preprocessing=P.PreprocessingConfig(use_pca=True, pca_components=6))
    assert projected.outputs["Ridge"].bundle.feature_names == [f"PC{i}" for i in range(1, 7)]


def test_targets_that_cannot_be_used(spark, assay):
    with pytest.raises(ValueError):
        T.train_and_compare(assay, "Nothing", "regression", ["Ridge"], "row_id", CONFIG)
    with pytest.raises(ValueError):
        T.train_and_compare(assay, "Potency", "regression", ["Unknown"], "row_id", CONFIG)
    df = spark.createDataFrame([(" b ",), ("a",), ("nan",), ("",), (None,), ("None",)], "t string")
    rows, labels = T.prepare_target(df, "t", "multiclass_classification")
    assert labels == ["a", "b"] and sorted(r["y"] for r in rows.collect()) == [0.0, 1.0]


@pytest.mark.parametrize("classes", [2, 3])
def test_folds_at_once_equal_folds_one_by_one(spark, classes):
    rng = np.random.default_rng(classes)
    rows = [(i, float((i + rng.integers(0, 2)) % classes), (rng.normal(size=4) + 0.9 * (i % classes)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y double, v array<double>").select("id", "y", array_to_vector("v").alias("features"))
    train = T.with_folds(df, 4, 1, "y")
    for selected in (None, [0, 2]):
        width = 4
        data = T._Data("multiclass", [str(i) for i in range(classes)], train, 400, width, list("abcd"), selected)
        for name in class_folds.NAMES:
            assert class_folds.takes(name, width, classes)
            at_once = class_folds.class_fold_metrics(train, name, 4, 1, classes, selected, width)
            one_by_one = T.cross_validate(name, data, 4, 1)
            assert np.allclose(sorted(tuple(r) for r in at_once.collect()), sorted(tuple(r) for r in one_by_one.collect()))
    assert not class_folds.takes("Logistic Regression", 2000, 3) and not class_folds.takes("Random Forest", 2, 2)


def test_separated_classes_and_absent_classes_end(spark):
    rows = [(i, float(i % 2), [10.0 * (i % 2) + (i % 5) / 10, 1.0]) for i in range(60)] + [(100, 2.0, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, y double, v array<double>").select("id", "y", array_to_vector("v").alias("features"), (F.col("id") % 3).alias("fold_0"))
    for name in class_folds.NAMES:
        got = class_folds.class_fold_metrics(df, name, 3, 1, 3, None, 2).collect()
        assert len(got) == 3 and all(r.accuracy > 0.9 for r in got)


def test_nearest_rows_in_single_precision_stay_exact():
    rng = np.random.default_rng(11)
    for offset, scale in ((0.0, 1.0), (1e6, 1e-3), (0.0, 1e25), (0.0, 1e-25)):
        train, asked = (np.round(rng.normal(size=(n, 6)), 1) * scale + offset for n in (9000, 300))
        ids, ys = rng.permutation(9000), rng.normal(size=9000)
        d = np.sqrt(((asked[:, None] - train[None]) ** 2).sum(2))
        want = [ids[np.lexsort((ids, row))[:5]].tolist() for row in d]
        kth = np.sort(d, axis=1)[:, 4]
        for within in (None, kth, kth * 2):
            found = NN._nearest(np.arange(300), asked, ids, train, ys, 5, within)
            assert [g["train_id"].tolist() for _, g in found.groupby("query_id")] == want
        assert NN._nearest(np.arange(300), asked, ids, train, ys, 5, np.sort(d, axis=1)[:, 0] * 0.5)["distance"].lt(d.min(axis=1).max()).all()


def test_neighbour_pages_in_several_rounds(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 20), ("PAGE_ROWS", 7), ("PART_QUERIES", 10), ("PART_ROWS", 50), ("PARTS_AT_ONCE", 4)):
        monkeypatch.setattr(NN, name, value)
    rng = np.random.default_rng(9)
    train, asked = rng.normal(size=(600, 40)), rng.normal(size=(30, 40))
    t = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(train)], "id bigint, v array<double>, y double")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id bigint, v array<double>")
    got = {}
    for r in sorted(NN.nearest_neighbors(q, t, "id", "id", "v", "y", 5, broadcast_bytes=0).collect(), key=lambda r: (r["query_id"], r["distance"], r["train_id"])):
        got.setdefault(r["query_id"], []).append((r["train_id"], r["y"]))
    for i, v in enumerate(asked):
        d = np.sqrt(((train - v) ** 2).sum(1))
        assert got[i] == [(j, float(j % 5)) for j in sorted(range(600), key=lambda j: (d[j], j))[:5]]


def test_only_ids_and_targets_are_ordered_for_the_split(spark, monkeypatch):
    rows = [(i // 2, float(i % 97), float(i), float(-i)) for i in range(400)]  # every id twice
    df = spark.createDataFrame(rows, "id bigint, y double, a double, b double").repartition(3).withColumn("__row", F.monotonically_increasing_id())
    table = df.localCheckpoint()
    seen, plain = [], SP.with_split
    monkeypatch.setattr(T, "with_split", lambda t, *rest: seen.append(set(t.columns)) or plain(t, *rest))
    placed = T._placed(table, "regression", SP.SplitConfig())
    found = placed.collect()
    assert seen == [{"__row", "id", "y"}] and placed.columns == ["id", "y", "a", "b", "split"]
    assert sorted((r.id, r.y, r.a, r.b) for r in found) == sorted(rows)
    whole = plain(table, "id", "y", "regression").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in whole} == {s: sum(r.split == s for r in found) for s in ("train", "val", "test")}
