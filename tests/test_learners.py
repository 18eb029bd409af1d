import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression

from residua.operators.preprocessing import PreprocessingConfig, fit_preprocessor
from residua.plans import boosting as BO
from residua.plans import epsilon as EPS
from residua.plans import extra_trees as XT
from residua.plans.stages import DescriptorPreprocessor, DescriptorPreprocessorModel


def vectors(spark, rows):
    df = spark.createDataFrame([(i, float(y), [float(v) for v in x]) for i, (x, y) in enumerate(rows)], "id long, label double, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features")).repartition(3)


def test_two_points_have_a_tube_of_their_own(spark):
    """The flattest line within ε of two points at x = -1 and x = 1 has slope 1 - ε between labels -1 and 1."""
    fitted = EPS.EpsilonInsensitiveRegression(regParam=1e-3, epsilon=0.1).fit(vectors(spark, [([-1.0], -1.0), ([1.0], 1.0)]))
    assert fitted.getOrDefault("weights")[0] == pytest.approx(0.9, abs=0.01) and fitted.getOrDefault("intercept") == pytest.approx(0, abs=0.01)
    flat = EPS.EpsilonInsensitiveRegression(regParam=1e-3, epsilon=1.5).fit(vectors(spark, [([-1.0], -1.0), ([1.0], 1.0)]))
    assert flat.getOrDefault("weights")[0] == pytest.approx(0, abs=1e-6)


def test_outliers_pull_no_harder_than_their_sign(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3.0 + rng.normal(size=400) * 0.02
    y[::20] += 500.0
    df = vectors(spark, zip(x, y))
    model = Pipeline(stages=[EPS.EpsilonInsensitiveRegression(regParam=1e-6, epsilon=0.05)]).fit(df)
    assert model.stages[0].getOrDefault("weights") == pytest.approx([1.0, -2.0, 0.5], abs=0.05)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df)
    assert sorted(r.prediction for r in again.collect()) == pytest.approx(sorted(r.prediction for r in model.transform(df).collect()))


def test_slopes_are_those_of_the_loss():
    r = np.linspace(-1, 1, 2001)
    for epsilon in (0.0, 0.1):
        loss, slope = EPS.loss_and_slope(r, epsilon)
        assert np.allclose(np.gradient(loss, r)[2:-2], slope[2:-2], atol=0.11) and np.all(loss[np.abs(r) <= epsilon] == 0)
        assert np.allclose(loss, np.maximum(np.abs(r) - epsilon, 0), atol=0.005)


def test_sums_and_splits_equal_a_plain_count():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 4)), rng.normal(size=300)
    for classes in (0, 3):
        labels = rng.integers(0, 3, 300).astype(float) if classes else y
        stats = XT._statistics(labels, classes)
        slot = rng.integers(-1, 5, 300)
        growing = XT._Growing(None, list(range(5)), {k: np.stack([x.min(0), x.max(0)]) for k in range(5)}, {})
        growing.draw(rng, 3)
        sums = XT.side_sums(x, stats, slot, growing)
        chosen = XT.chosen_splits(sums, classes)
        for k in range(5):
            mine = slot == k
            best = (-1, -np.inf)
            for d in range(3):
                left = mine & (x[:, growing.features[k, d]] <= growing.points[k, d])
                assert np.allclose(sums[k, d], stats[left].sum(0)) and np.allclose(sums[k, 3], stats[mine].sum(0))
                spread = lambda rows: (len(rows) * rows.var() if not classes else len(rows) - (np.unique(rows, return_counts=True)[1] ** 2).sum() / len(rows)) if len(rows) else 0
                right = mine & ~left
                gain = spread(labels[mine]) - spread(labels[left]) - spread(labels[right])
                if left.any() and right.any() and gain > best[1]:
                    best = (d, gain)
            assert chosen[k, 0] == best[0] and chosen[k, 1] == pytest.approx(best[1])


@pytest.mark.parametrize("classes", [0, 3])
def test_extra_trees_learn_repeat_and_survive_storage(spark, tmp_path, classes):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(300, 3))
    y = (x[:, 0] > 0.2).astype(float) + (x[:, 1] > 0) if classes else np.sin(3 * x[:, 0]) + 0.1 * x[:, 1]
    df = vectors(spark, zip(x, y))
    settings = {"numTrees": 12, "maxDepth": 8, "classes": classes}
    pipeline = Pipeline(stages=[XT.ExtraTrees(**settings)]).fit(df)
    scored = {r.id: (r.prediction, r.label) for r in pipeline.transform(df).collect()}
    found, wanted = np.array(sorted(scored.values())).T
    assert len(scored) == 300 and np.isfinite(found).all()
    assert np.mean(found == wanted) > 0.93 if classes else np.mean((found - wanted) ** 2) < 0.1 * np.var(wanted)
    model = pipeline.stages[0]
    assert len(model.trees) == 12 and np.argmax(model.featureImportances) in (0, 1) and sum(model.featureImportances) == pytest.approx(1)
    for tree in model.trees:
        assert max(tree.left + tree.right) == len(tree.feature) - 1 and all((f >= 0) == (a > 0) for f, a in zip(tree.feature, tree.left))
    again = XT.ExtraTrees(**settings).fit(df.repartition(5))
    assert all(a.feature == b.feature and np.allclose(a.threshold, b.threshold) for a, b in zip(again.trees, model.trees))
    pipeline.write().overwrite().save(str(tmp_path / "m"))
    loaded = {r.id: r.prediction for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect()}
    assert loaded == {i: p for i, (p, _) in scored.items()}
    if classes:
        shares = [r.probability.toArray() for r in pipeline.transform(df).collect()]
        assert np.allclose([s.sum() for s in shares], 1)


def test_extra_trees_take_any_seed(spark):
    same = vectors(spark, [([1.0, 2.0], float(i % 2)) for i in range(10)])
    assert {r.prediction for r in XT.ExtraTrees(numTrees=2, seed=-5).fit(same).transform(same).collect()} == {0.5}


def test_extra_trees_of_odd_tables(spark):
    same = vectors(spark, [([1.0, 2.0], float(i % 2)) for i in range(10)])  # nothing to split
    assert {r.prediction for r in XT.ExtraTrees(numTrees=3).fit(same).transform(same).collect()} == {0.5}
    flat = vectors(spark, [([float(i)], 7.0) for i in range(10)])
    assert {r.prediction for r in XT.ExtraTrees(numTrees=3).fit(flat).transform(flat).collect()} == {7.0}
    assert XT.ExtraTrees(numTrees=3).fit(flat.limit(0)).trees == []


@pytest.mark.parametrize("components", [0, 2])
def test_one_pipeline_holds_preprocessing_and_model(spark, tmp_path, components):
    rng = np.random.default_rng(2)
    rows = [(i, *(None if rng.random() < 0.1 else float(v) for v in rng.normal(size=3)), 1.0, float(rng.normal()), "keep") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, `b c` double, d double, flat double, y double, features string")
    stages = [DescriptorPreprocessor(inputCols=["a", "b c", "d", "flat"], components=components, scaler="robust"), LinearRegression(labelCol="y")]
    fitted = Pipeline(stages=stages).fit(df)
    assert fitted.stages[0].featureNames == (["PC1", "PC2"] if components else ["a", "b c", "d"])
    fitted.write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert isinstance(loaded.stages[0], DescriptorPreprocessorModel)
    new = df.drop("d", "flat", "y")  # columns that are not there count as filled
    before, after = ({r.id: r.prediction for r in m.transform(new).collect()} for m in (fitted, loaded))
    assert before == pytest.approx(after) and len(after) == 200 and loaded.transform(new).columns[:3] == ["id", "a", "b c"]
    plain = fit_preprocessor(df, ["a", "b c", "d", "flat"], PreprocessingConfig(scaler="robust", use_pca=components > 0, pca_components=components or 20))
    got = {r.id: tuple(r.features) for r in loaded.stages[0].transform(df).collect()}
    assert all(np.allclose(got[r.id], r.features) for r in plain.transform(df, ["id"]).collect())


def test_splits_of_a_histogram_equal_a_plain_search():
    rng = np.random.default_rng(9)
    binned, node, r = rng.integers(0, 5, (200, 3)), rng.integers(-1, 2, 200), rng.normal(size=200)
    stats = np.column_stack([np.ones(200), r, np.abs(r)])
    found = BO.best_splits(BO.histogram(binned, node, 2, stats, 5))
    for k in range(2):
        best = (-1.0, None)
        for f in range(3):
            for b in range(4):
                left, right = (node == k) & (binned[:, f] <= b), (node == k) & (binned[:, f] > b)
                if left.any() and right.any():
                    gain = (r[left].mean() - r[right].mean()) ** 2 * left.sum() * right.sum() / (left.sum() + right.sum())
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b, stats[left].sum(0), stats[right].sum(0)))
        assert found[k, 2] == pytest.approx(best[0]) and tuple(found[k, :2]) == best[1][:2]
        assert np.allclose(found[k, 3:6], best[1][2]) and np.allclose(found[k, 6:], best[1][3])


def test_softmax_boosting_lowers_the_loss_every_round(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(BO, "STORED_EVERY", 3)
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, size=(300, 3))
    y = (x[:, 0] > 0.3).astype(float) + (x[:, 1] > 0)
    df = vectors(spark, zip(x, y))
    pipeline = Pipeline(stages=[BO.SoftmaxBoosting(classes=3, maxIter=8, stepSize=0.3)]).fit(df)
    model = pipeline.stages[0]
    assert len(model.losses) == 8 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    counts = np.bincount(y.astype(int), minlength=3) / 300
    assert model.losses[0] == pytest.approx(-(counts * np.log(counts)).sum())
    rows = pipeline.transform(df).collect()
    shares = np.array([r.probability.toArray() for r in rows])
    assert np.allclose(shares.sum(axis=1), 1) and np.mean([r.prediction == r.label for r in rows]) > 0.95
    assert -np.mean(np.log(shares[np.arange(300), [int(r.label) for r in rows]])) < model.losses[-1]
    pipeline.write().overwrite().save(str(tmp_path / "b"))
    again = PipelineModel.load(str(tmp_path / "b"))
    assert np.allclose(shares, [r.probability.toArray() for r in again.transform(df).collect()]) and again.stages[0].losses == model.losses
    assert BO.SoftmaxBoosting(classes=3).fit(df.limit(0)).rounds == []


def test_softmax_boosting_goes_on_with_counted_bins(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 2)), 1)
    rows = [(v, float(v[0] > 0.3) + float(v[1] > 0)) for v in x]
    plain, many = vectors(spark, rows), vectors(spark, rows * 4)
    boosting = BO.SoftmaxBoosting(classes=3, maxIter=6, stepSize=0.3)
    once, again = boosting.fit(plain), boosting.fit(many)
    assert once.losses == pytest.approx(again.losses)
    for a, b in zip((t for r in once.rounds for t in r), (t for r in again.rounds for t in r)):
        assert a.feature == b.feature and np.allclose(a.threshold, b.threshold) and np.allclose(np.ravel(a.value), np.ravel(b.value))
    edges = [np.array([-0.5, 0.5]), np.array([0.0])]
    table = many.select(BO.vector_to_array("features").alias("v"), many.label.cast("int").alias("y"))
    counted = BO._counted(table, edges, 2).collect()
    assert len(counted) <= 3 * 2 * 3 and sum(r.w for r in counted) == 3600
    assert {tuple(r.v) for r in counted} <= {(a, b) for a in (-0.5, 0.5, np.inf) for b in (0.0, np.inf)}
