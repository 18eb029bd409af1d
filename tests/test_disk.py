import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions.descriptors import DescriptorConfig, with_descriptors
from residua.operators import neighbors as NN
from residua.operators.storage import materialize, stored_tables
from residua.plans import training as T
from tests.conftest import peptide

CONFIG = DescriptorConfig(include_fingerprints=False, include_elemental=False)


@pytest.fixture(scope="module")
def assay(spark):
    rows = [(i, peptide(i, 6 + i % 9)) for i in range(240)]
    df = with_descriptors(spark.createDataFrame(rows, "row_id bigint, Sequence string"), config=CONFIG)
    return materialize(df.withColumn("Potency", F.col("Gravy") * 3.0 + F.col("row_id") * 37 % 11 / 11.0))


def _shuffled(spark) -> int:
    """Bytes of shuffle that all stages so far wrote."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_search_of_all_pairs_neither_copies_nor_leaves_rows(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 20), ("PAGE_ROWS", 7), ("PART_QUERIES", 10), ("PART_ROWS", 50), ("MOST_VISITS", 1)):
        monkeypatch.setattr(NN, name, value)
    rng = np.random.default_rng(5)
    train, asked = rng.normal(size=(1000, 40)), rng.normal(size=(200, 40))
    train[100:130] = train[7]
    t = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(train)], "id bigint, v array<double>, y double").localCheckpoint()
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id bigint, v array<double>").localCheckpoint()
    before, stored = _shuffled(spark), set(stored_tables(spark))
    rows = NN.nearest_neighbors(q, t, "id", "id", "v", "y", 5, broadcast_bytes=0)
    left = set(stored_tables(spark)) - stored
    assert _shuffled(spark) - before < 8 * 40 * (1000 + 200) * 2  # every wide row moved twice at most, not once for each part of the other side
    assert len(left) == 1 and "/neighbours-" in left.pop()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["distance"], r["train_id"])):
        got.setdefault(r["query_id"], []).append(r["train_id"])
    for i, v in enumerate(asked):
        d = np.sqrt(((train - v) ** 2).sum(1))
        assert got[i] == sorted(range(1000), key=lambda j: (d[j], j))[:5]


def test_few_queries_are_held_against_cuts_of_the_rows(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 20), ("PAGE_ROWS", 7), ("PART_ROWS", 50), ("MOST_VISITS", 1), ("PARTS_AT_ONCE", 9)):
        monkeypatch.setattr(NN, name, value)
    rng = np.random.default_rng(6)
    train, asked = rng.normal(size=(1000, 40)), rng.normal(size=(3, 40))
    t = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(train)], "id bigint, v array<double>, y double")
    q = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(asked)] + [(None, asked[0].tolist())], "id bigint, v array<double>")
    found = NN.nearest_neighbors(q, t, "id", "id", "v", "y", 1, broadcast_bytes=0).collect()
    d = np.sqrt(((asked[:, None] - train[None]) ** 2).sum(2))
    near = {0: min((d[i, j], j) for i in (0, 2) for j in range(1000)), 1: min((d[1, j], j) for j in range(1000))}
    assert {r["query_id"]: r["train_id"] for r in found} == {i: j for i, (_, j) in near.items()} and len(found) == 2


def test_training_leaves_only_tables_that_its_results_read(spark, assay):
    stored = set(stored_tables(spark))
    result = T.train_and_compare(assay, "Potency", "regression", ["kNN"], "row_id", CONFIG, folds=2)
    names = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(stored_tables(spark)) - stored]
    assert not {"training", "split", "ordered", "ordered-input", "rest", "reference", "cells", "known"} & set(names)
    assert result.outputs["kNN"].test.count() and result.outputs["kNN"].validation.count() and result.outputs["kNN"].folds.count()
    assert result.outputs["kNN"].bundle.apply(assay, ["row_id"], "row_id").count()
