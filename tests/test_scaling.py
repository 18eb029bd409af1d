"""Steps that have to spread over all cores and grow no faster than their input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from query_suite import inputs as I
from residua.functions import alignment as A
from residua.operators import design as D
from residua.operators import neighbors as NN
from residua.operators import user_scales as U
from residua.plans.extra_trees import ExtraTrees, Tree, _Growing

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [I.peptides, I.raw_peptides, I.long_peptides])
def test_input_of_one_row_group_is_dealt_to_all_cores(spark, made):
    rows = made(spark, SMALL)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    filled = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(n > 0 for n in filled) > 1


def test_scales_of_short_long_and_empty_sequences(spark):
    values = {a: float(i) - 2.5 for i, a in enumerate("ACDEF")}
    scales = spark.createDataFrame([("s", a, v) for a, v in values.items()] + [("t", "A", 1.0)], "scale string, residue string, value double")
    sequences = ["", "A", "ACDEF", "AAX", "ACDEF" * 10_000, "A" * U.SHORT, "AC" * U.SHORT]
    rows = spark.createDataFrame(list(enumerate(sequences)), "id int, s string")
    found = {(r.id, r.scale): (r.total, r.mean) for r in U.scale_sums(rows, ["id"], scales, "s").collect()}
    U.register_sql(spark, scales)
    rows.createOrReplaceTempView("__rows")
    said = spark.sql("SELECT id, scale, scale_sum(s, residue_values), scale_mean(s, residue_values) FROM __rows CROSS JOIN scale_maps").collect()
    for n, s in enumerate(sequences):
        for scale, known in (("s", values), ("t", {"A": 1.0})):
            total = sum(known[c] for c in s) if set(s) <= set(known) else None
            mean = total / len(s) if s and total is not None else None
            assert found[n, scale] == (total, mean)
            assert [tuple(r)[2:] for r in said if (r.id, r.scale) == (n, scale)] == [(total, mean)]


def test_letters_are_counted_once_per_sequence_not_per_scale(spark):
    scales = spark.createDataFrame([("s", "A", 1.0)], "scale string, residue string, value double")
    plan = U.scale_sums(spark.range(3).selectExpr("id", "'AA' || id AS s"), ["id"], scales, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan.split("Join")[0]


def test_large_reference_table_is_never_held_against_every_query(spark, monkeypatch):
    rows = spark.range(4_000).selectExpr("id", "sin(id * 1.7) AS a", "cos(id * 0.3) AS b", "id % 7 AS y")
    monkeypatch.setattr(NN, "BROADCAST_ROWS", 1_000)
    monkeypatch.setattr(NN, "_broadcast_search", None)
    asked = rows.where("id % 40 = 0")
    found = {}
    for r in NN.nearest_neighbors(asked, rows, "id", "id", ["a", "b"], "y", 3).collect():
        found.setdefault(r["query_id"], []).append((r["distance"], r["train_id"]))
    ids = np.arange(4_000)
    points = np.column_stack([np.sin(ids * 1.7), np.cos(ids * 0.3)])
    assert len(found) == 100
    for q, near in found.items():
        distances = np.sqrt(((points - points[q]) ** 2).sum(1))
        assert [t for _, t in sorted(near)] == list(np.lexsort((ids, distances))[:3])


def test_trees_have_a_seed_that_does_not_hang_on_the_interpreter(spark):
    assert ExtraTrees().getSeed() == 42


def test_scans_of_growing_trees_get_arrays_without_boxes_and_values():
    tree = Tree([0, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [np.zeros(1)] * 3, [1.0, 0.0, 0.0])
    growing = _Growing(tree, [1, 2], {1: np.zeros((2, 1)), 2: np.zeros((2, 1))}, {1: 4, 2: 4})
    growing.draw(np.random.default_rng(0), 1)
    sent = growing.sent()
    assert not sent.boxes and not sent.tree.value
    assert sent.tree.place(np.array([[0.2], [0.9]])).tolist() == tree.place(np.array([[0.2], [0.9]])).tolist() == [1, 2]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distances_side_by_side_equal_the_table_of_each_pair(spark):
    rng = random.Random(5)
    for letters in ("AC", "ACDEFGHIKLMNPQRSTVWY", "A\0é\U0001f600"):
        reference = "".join(rng.choices(letters, k=70))
        sequences = ["".join(rng.choices(letters + "Z", k=rng.choice([0, 1, 2, 31, 64, 70, 150]))) for _ in range(60)] + [reference]
        for start, end in [*A._parts(sequences, 500), (0, len(sequences))]:
            distances, shared = A.compared(reference, sequences[start:end])
            assert distances.tolist() == [_edits(reference, s) for s in sequences[start:end]]
            assert shared.tolist() == [sum(a == b for a, b in zip(reference, s)) for s in sequences[start:end]]
        assert A.compared("", sequences)[0].tolist() == [len(s) for s in sequences]
    rows = spark.createDataFrame([("AKL", "AL"), (None, "A"), ("A", None), ("K", "AK"), ("", "")], "r string, s string")
    found = rows.select("r", "s", A.comparison(F.col("r"), F.col("s")).alias("c"), F.levenshtein("r", "s").alias("d")).collect()
    assert all(x["c"]["distance"] == x["d"] for x in found)


def test_summaries_of_changes_cut_and_whole():
    assert A.summaries("AKLV", ["AKLV", "AKL", "CKLW", "CCCCCC", ""], 3) == ["Reference", "-1 residue(s)", "A1C, V4W", "A1C, K2C, L3C ...", "-4 residue(s)"]
    assert A.summaries("AKLV", ["CCCCCC", "C\u00e9L\U0001f600"], None) == ["A1C, K2C, L3C, V4C, +2 residue(s)", "A1C, K2\u00e9, V4\U0001f600"]
    assert A.summaries("AK", ["CCC"], 2) == ["A1C, K2C ..."] and A.summaries("AK", ["CC"], 2) == ["A1C, K2C"]


def test_only_the_first_rows_get_a_summary_of_their_changes(spark):
    rows = spark.range(200).selectExpr("id", "concat('AKLVWY', translate(id, '0123456789', 'ACDEFGHIKL')) AS Sequence", "cast(id % 7 AS double) AS Activity")
    every = D.sort_alignment(D.alignment_to_reference(rows, "Sequence", "Activity", ["id"], most_changes=12), ["id"], 9)
    first = D.sort_alignment(D.alignment_to_reference(rows, "Sequence", "Activity", ["id"], most_changes=12, top_n=9), ["id"], 9)
    assert first.collect() == every.collect() and first.count() == 9
    assert "_compare" not in first._jdf.queryExecution().optimizedPlan().toString()  # the few rows are stored before their summaries are made


def test_long_peptides_hold_the_letters_of_every_text(spark, tmp_path):
    texts = ["", None, "b o\u00e4Z", "Aky \u212a \u017f\U0001f600 w\nV", "acdefghiklmnpqrstvwyBJOUXZ09", "\u0130\u0131 k"]
    rows = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: (r["sequence"], r["activity"]) for r in I.long_peptides(spark, str(tmp_path)).collect()}
    wanted = rows.selectExpr("doc_id", "upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '')) AS s", "-abs(cast(n_chars AS DOUBLE) - 1000.0) AS a")
    assert found == {r["doc_id"]: (r["s"], r["a"]) for r in wanted.collect()}
    assert "regexp_replace" not in I.long_peptides(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
