import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from residua.functions import constants as K
from residua.functions import naming as N
from residua.functions import ordered
from residua.functions.descriptors import (
    DescriptorConfig, descriptor_columns, descriptor_names, dipeptides_long, with_descriptors,
)
from residua.functions.numbers import format_significant, round_half_even
from residua.functions.sequences import clean_sequence, has_residues, invalid_characters, to_number
from tests.conftest import peptide


def test_descriptors_of_hand_cases(spark):
    df = spark.createDataFrame([("KKKK",), ("A",), (" akl\tvff ",), ("",), (None,), ("   ",)], "Sequence string")
    rows = {r["Sequence"]: r.asDict() for r in with_descriptors(df, config=DescriptorConfig(include_dipeptide=True)).collect()}
    assert set(rows) == {"KKKK", "A", "AKLVFF"}
    assert rows["KKKK"]["Motif_KK"] == pytest.approx(2 / 3) and rows["KKKK"]["DPC_KK"] == 1.0
    assert rows["A"]["Motif_KK"] == 0.0 and sum(v for k, v in rows["A"].items() if k.startswith("DPC_")) == 0.0
    assert rows["A"]["InstabilityIndex"] == 0.0 and rows["A"]["MolecularWeight"] == pytest.approx(89.0932)
    a = rows["AKLVFF"]
    assert a["Gravy"] == a["Hydrophobicity_KD"] == pytest.approx((1.8 - 3.9 + 3.8 + 4.2 + 2.8 + 2.8) / 6)
    assert a["AliphaticIndex"] == pytest.approx(100 / 6 * (1 + 2.9 + 3.9))
    assert a["InstabilityIndex"] == pytest.approx(10 / 6 * (1.0 - 7.49 + 1.0 + 1.0 + 1.0))
    x = sum(K.SCALES["kd"][c] * math.cos(i * math.radians(100)) for i, c in enumerate("AKLVFF"))
    y = sum(K.SCALES["kd"][c] * math.sin(i * math.radians(100)) for i, c in enumerate("AKLVFF"))
    assert a["HydrophobicMoment100"] == pytest.approx(math.hypot(x, y) / 6)


def test_descriptor_invariants(spark):
    df = spark.createDataFrame([(peptide(i, 1 + i % 30),) for i in range(200)], "Sequence string")
    for r in with_descriptors(df, config=DescriptorConfig(include_dipeptide=True)).collect():
        assert sum(r[f"AAC_{aa}"] for aa in K.ALPHABET) == pytest.approx(1.0)
        assert sum(v for k, v in r.asDict().items() if k.startswith("DPC_")) == pytest.approx(1.0 if r["Length"] > 1 else 0.0)
        assert 4.05 <= r["IsoelectricPoint"] <= 12.0
        mass = 12.011 * r["Elem_C"] + 1.008 * r["Elem_H"] + 14.007 * r["Elem_N"] + 15.999 * r["Elem_O"] + 32.06 * r["Elem_S"]
        assert r["MolecularWeight"] == pytest.approx(mass, rel=1e-3)
        assert r["Elem_H"] == sum(K.SCALES["H"][c] for c in r["Sequence"]) + 2


def test_input_columns_survive_and_same_name_is_replaced(spark):
    df = spark.createDataFrame([("x", "AAA", 99.0, 1.5)], "`Docking Score` string, pep string, Length double, IC50 double")
    out = with_descriptors(df, "pep")
    row = out.first()
    assert row["Docking Score"] == "x" and row["Length"] == 3 and "pep" not in out.columns
    assert descriptor_columns(out) == descriptor_names()


def test_unused_ordered_descriptors_cost_no_python(spark):
    df = with_descriptors(spark.createDataFrame([("AAA",)], "Sequence string"))
    plan = df.select("Length", "Gravy")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_row_local_descriptors_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("AKLVFF",), ("KKKK",)], "Sequence string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Sequence string").parquet(str(tmp_path / "in"))
    query = with_descriptors(stream, only=["Gravy", "IsoelectricPoint"]).writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("streamed").count() == 2


def test_long_dipeptides_count_overlaps(spark):
    df = spark.createDataFrame([(1, "KKKAK"), (2, "A"), (3, "AX")], "id int, Sequence string")
    rows = {(r["id"], r["Dipeptide"]): (r["Count"], r["Frequency"]) for r in dipeptides_long(df, ["id"]).collect()}
    assert rows == {(1, "KK"): (2, 0.5), (1, "KA"): (1, 0.25), (1, "AK"): (1, 0.25)}


def test_cleaning_and_characters(spark):
    values = [" ak l\x1cv ", None, "\t\n", "AKLVFFB", "zaZ*"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", clean_sequence(F.col("s")).alias("c"), has_residues(F.col("s")).alias("h")).orderBy("i").collect()
    assert [r["c"] for r in rows] == ["AKLV", "", "", "AKLVFFB", "ZAZ*"]
    assert [r["h"] for r in rows] == [c != "" for c in ("AKLV", "", "", "AKLVFFB", "ZAZ*")]
    found = df.select(invalid_characters(clean_sequence(F.col("s"))).alias("x"), "i").orderBy("i").collect()
    assert [r["x"] for r in found] == ["", "", "", "B", "*Z"]


def test_number_parsing(spark):
    texts = ["1", " 2.5 ", "-3e2", "5F", "1d", "abc", "", None, "nan", ".5", "7."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r["n"] for r in df.select("i", to_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert found == [1.0, 2.5, -300.0, None, None, None, None, None, None, 0.5, 7.0]


def test_rounding_and_short_text_follow_the_exact_value(spark):
    rng = random.Random(1)
    values = [56.25, 1.005, 999.6, 0.0125, 1234.5, 0.0625, 1e-5, 0.0, 1e10, 99.95, 0.1, 1e22, -2.675]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 7) for _ in range(300)]
    values += [rng.randint(0, 9999) / 10 ** rng.randint(0, 5) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.select("v", format_significant(F.col("v")).alias("t"), round_half_even(F.col("v"), 3).alias("r")).collect()
    for row in found:
        assert row["t"] == f"{row['v']:.3g}" and row["r"] == round(row["v"], 3)


@given(st.text(max_size=12))
@settings(max_examples=50, deadline=None)
def test_header_normalisation_keeps_letters_and_digits(name):
    assert all(c.isascii() and (c.isdigit() or c.islower()) for c in N.normalize_header(name))


def test_name_rules():
    assert N.scoring_direction("Binding_Score") == "minimize" and N.design_direction("BindingScore") == "maximize"
    assert N.scoring_direction("Affinity") == "maximize" and N.design_direction("Affinity") == "minimize"
    assert N.design_direction("kinetics") == "minimize" and N.design_direction(None) == "maximize"
    assert [N.task_type(t) for t in ("Binary", "multi-class", "classification_multiclass", "classification", None)] == [
        N.BINARY, N.MULTICLASS, N.MULTICLASS, N.BINARY, N.REGRESSION]
    families = {"Ridge": "Linear", "SVM (RBF)": "Nonlinear Kernel", "kNN": "Nonlinear Distance", "Extra Trees": "Tree Ensemble",
                "MLP Classifier": "Neural", "Naive Bayes": "Probabilistic", "Other thing": "Other", "Logistic Regression": "Linear"}
    assert {m: N.model_family(m) for m in families} == families


def test_target_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0, "low")], "id int, mass double, note string, IC50 double, ToxicityClass string")
    assert N.target_columns(df) == ["IC50", "ToxicityClass", "mass"]


def test_points_are_solved_once_for_each_signature(spark, monkeypatch):
    solved = []
    solve = ordered.solve_points
    monkeypatch.setattr(ordered, "solve_points", lambda counts, n, c: (solved.append(len(n)), solve(counts, n, c))[1])
    sequences = ["AKDA", "ADKA", "AGKGDGA", "KDAA", "", "A" * 60 + "C" * 3000, "CAKA", None, "AKDA"]
    got = ordered._by_chunk(pa.array(sequences), ordered._isoelectric).to_pylist()
    assert got[0] == got[1] == got[2] == got[8] != got[3] and got[4] is None and got[7] is None
    assert sum(solved) == 5  # one for AKDA and its like, KDAA, no residue at all, the long one, CAKA
    one_by_one = [ordered._by_chunk(pa.array([s]), ordered._isoelectric).to_pylist()[0] for s in sequences]
    assert got == one_by_one
