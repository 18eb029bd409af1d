import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.operators import gram
from residua.operators import profiling as DP
from residua.operators import quantiles


def gappy(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7)) * [1, 1e-3, 1e6, 1, 1, 1, 1] + [0, 5, 1e9, 1e12, 0, 3, 0]
    x[:, 4] = x[:, 0] * 2 + rng.normal(size=n) * 0.1
    x[:, 5] = 3.25  # flat
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan  # nothing at all
    x[::2, 1] = np.nan
    x[1::2, 0] = np.nan  # the first two never meet
    return x


def plain(x, i, j):
    both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return None
    return np.corrcoef(a, b)[0, 1]


@pytest.mark.parametrize("parts", [1, 9])
def test_correlations_of_incomplete_columns(spark, parts):
    x = gappy()
    names = [f"c {i}" for i in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(parts)
    got = {(r.feature_i, r.feature_j): r["corr"] for r in DP.correlation_matrix(df, names).collect()}
    assert len(got) == len(names) ** 2
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            expected = plain(x, i, j)
            assert got[a, b] is None if expected is None else got[a, b] == pytest.approx(expected, abs=1e-9), (a, b)
    pairs = DP.correlation_values(df, names)
    assert all(v is None and got[p] is None or v == pytest.approx(got[p]) for p, v in pairs.items()) and len(pairs) == 21


def test_correlations_of_text_empty_and_infinite_values(spark):
    df = spark.createDataFrame([("1", 2.0, 1), ("2", 4.0, 1), ("x", 9.0, 2), ("4", 8.0, 2), ("5", float("inf"), 3), (None, float("nan"), 3)], "a string, b double, c int")
    got = DP.correlation_values(df, ["a", "b", "c"])
    assert got["a", "b"] == pytest.approx(1.0) and got["b", "c"] == pytest.approx(np.corrcoef([2, 4, 9, 8], [1, 1, 2, 2])[0, 1])
    none = DP.correlation_matrix(df.where("c > 9"), ["a", "b"]).collect()
    assert len(none) == 4 and all(r["corr"] is None for r in none)
    assert DP.correlation_values(df.where("c > 9"), ["a", "b"]) == {("a", "b"): None}


def test_sums_are_the_same_about_any_offset():
    x = gappy(400)
    whole, parts = gram.Moments(7), [gram.Moments(7) for _ in range(4)]
    whole.add(x)
    for k, part in enumerate(parts):
        for at in range(100 * k, 100 * k + 100, 30):
            part.add(x[at:min(at + 30, 100 * k + 100)])
    rows = sorted((r for p in [whole] for r in p.rows().to_pylist()), key=lambda r: r["place"])
    stacked = sorted((r for p in parts for r in p.rows().to_pylist()), key=lambda r: r["place"])

    schema = whole.rows().schema
    one, many = (next(iter([list(gram._added(iter([pa.RecordBatch.from_pylist(rs, schema=schema)])))])) for rs in (rows, stacked))
    for a, b in zip(one, many):
        a, b = a.to_pylist()[0], b.to_pylist()[0]
        assert a["place"] == b["place"] and a["n"] == b["n"]
        assert all((u is None) == (v is None) and (u is None or u == pytest.approx(v, abs=1e-9)) for u, v in zip(a["corr"], b["corr"]))


def test_a_wide_table_takes_one_scan(spark):
    width = 120
    df = spark.range(500).select(*[(F.rand(i) + F.col("id") * (i % 3)).alias(f"c{i}") for i in range(width)])
    df = df.select(*[F.when(F.rand(200 + i) > 0.1, F.col(f"c{i}")).alias(f"c{i}") for i in range(width)])
    plan = DP.correlation_matrix(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    assert DP.correlation_matrix(df, df.columns).where("corr is null").count() == 0


def test_sketch_brackets_hold_every_rank():
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=60_000), np.arange(50_000.0), np.repeat(rng.integers(0, 40, 300), 200).astype(float), np.sort(rng.lognormal(0, 5, 40_000))[::-1]):
        parts = [quantiles.Sketch() for _ in range(7)]
        for i in range(0, len(values), 900):
            parts[i // 900 % 7].add(values[i:i + 900])
        whole = quantiles.Sketch()
        for part in parts:
            whole.merge(part)
        order = np.sort(values)
        assert whole.count == len(values) and all(len(run) <= quantiles.RUN for run in whole.runs)
        for rank in range(0, len(values), 997):
            low, high = whole.bracket(rank)
            assert low <= order[rank] <= high
            assert np.searchsorted(order, high, "left") - np.searchsorted(order, low, "right") < 0.03 * len(values)


def test_quantiles_take_two_scans_at_any_number_of_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LEAF_VALUES", 3)  # the brackets are narrowed, the table is not read again
    monkeypatch.setattr(quantiles, "BINS", 4)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    columns = [f"c{i}" for i in range(30)]
    rows = spark.range(20_000, numPartitions=5).select(*[(F.col("id") * (i + 1) % 9973 / (i + 1.0)).alias(c) for i, c in enumerate(columns)])
    found = quantiles.exact_quantiles(rows.mapInArrow(counted, rows.schema), columns, [0.1, 0.5, 0.9])
    assert read.value == 40_000
    for i, c in enumerate(columns):
        values = np.arange(20_000) * (i + 1) % 9973 / (i + 1.0)
        assert [found[c].values[p] for p in (0.1, 0.5, 0.9)] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]), rel=1e-12)
