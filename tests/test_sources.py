import pytest

from residua.sources import readers as RD
from residua.sources import writers as WR


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def _pairs(df):
    return [(r["Name"], r["Sequence"]) for r in df.orderBy("record").collect()]


FASTA = "; junk\nAKL\n>one  \r\nak l\r\n\r\nVF\r\n  >two\nGG\n>\nKK\n> \n>empty\n>last\nRR"
EXPECTED = [("one", "AKLVF"), ("two", "GG"), ("Sequence_3", "KK"), ("Sequence_4", ""), ("empty", ""), ("last", "RR")]


def test_fasta_rules(spark, tmp_path):
    path = _write(tmp_path, "a.fasta", FASTA)
    assert _pairs(RD.read_table(spark, path)) == EXPECTED
    assert _pairs(RD.read_fasta(spark, _write(tmp_path, "b.fa", ">x\nAA\n>y\nCC\n"))) == [("x", "AA"), ("y", "CC")]


def test_large_fasta_is_split_and_keeps_its_order(spark, tmp_path):
    text = "junk\n" + "".join(f">{'' if i % 10 == 0 else f'p{i}'}\nAKL\nVF\n" for i in range(5000))
    path = _write(tmp_path, "big.fa", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = _pairs(RD.read_fasta(spark, path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(f"Sequence_{i + 1}" if i % 10 == 0 else f"p{i}", "AKLVF") for i in range(5000)]


def test_pasted_blocks(spark):
    texts = [(1, "AKLVFF, GIGA;KK\tRR"), (2, FASTA), (3, "  "), (4, None), (5, "a > b")]
    df = spark.createDataFrame(texts, "id int, text string")
    out = RD.parse_sequence_blocks(df, "text")
    assert _pairs(out.filter("id = 1")) == [("Manual_1", "AKLVFF"), ("Manual_2", "GIGA"), ("Manual_3", "KK"), ("Manual_4", "RR")]
    assert _pairs(out.filter("id = 2")) == EXPECTED
    assert out.filter("id in (3, 4)").count() == 0
    assert _pairs(out.filter("id = 5")) == [("Manual_1", "A"), ("Manual_2", ">"), ("Manual_3", "B")]


SDF = """mol-1
  prog

  0  0
M  END
> <Peptide Sequence>
akl v

> <Mass>
12.5

>  <note>
first line
 second line

$$$$
AKLVFF
  prog

M  END
> <Mass>
13

> <odd>
1

$$$$

third
M  END
> <remark>
12

> <free>
GIGAV

> <Mass>
14

$$$$
"""


def test_sdf_rules(spark, tmp_path):
    table = RD.read_table(spark, _write(tmp_path, "m.sdf", SDF))
    assert table.columns == ["file", "record", "Name", "Sequence", "Peptide Sequence", "Mass", "note", "odd", "remark", "free"]
    rows = table.orderBy("record").collect()
    assert [(r["Name"], r["Sequence"], r["Mass"]) for r in rows] == [("mol-1", "AKLV", 12.5), ("AKLVFF", "AKLVFF", 13.0), ("third", "GIGAV", 14.0)]
    assert rows[0]["note"] == "first line second line"
    assert dict(table.dtypes)["Mass"] == "double" and dict(table.dtypes)["odd"] == "string"
    wanted = RD.read_sdf(spark, _write(tmp_path, "n.sdf", SDF), ["Mass", "absent"])
    assert wanted.columns[-2:] == ["Mass", "absent"] and dict(wanted.dtypes)["Mass"] == "double" and wanted.where("absent is null").count() == 3


def test_sdf_names_beyond_columns_become_maps(spark, tmp_path, monkeypatch):
    path = _write(tmp_path, "many.sdf", SDF + "again\nM  END\n> <Mass>\nheavy\n\n> <Mass>\n15\n\n$$$$\nbare\nM  END\n$$$$\n")
    long = {(r.record, r.key): (r.value, r.number) for r in RD.read_sdf_long(spark, path).collect()}
    assert len(long) == 9 and long[1, "Mass"] == ("12.5", 12.5) and long[4, "Mass"] == ("15", 15.0) and long[3, "remark"] == ("12", None)
    monkeypatch.setattr(RD, "MOST_COLUMNS", 3)
    rows = {r.record: r for r in RD.read_sdf(spark, path).collect()}
    assert rows[1].properties == {"Peptide Sequence": "akl v", "Mass": "12.5", "note": "first line second line"} and rows[1].numbers == {"Mass": 12.5}
    assert rows[4].properties == {"Mass": "15"} and rows[5].properties == {} == rows[5].numbers and rows[5].Name == "bare"
    monkeypatch.setattr(RD, "BROADCAST_KEYS", 0)
    assert {(r.record, r.key): (r.value, r.number) for r in RD.read_sdf_long(spark, path).collect()} == long


def test_text_files(spark, tmp_path):
    tab = RD.read_table(spark, _write(tmp_path, "t.txt", "Name\tSequence\tIC50\na\tAKL\t1.5\nb\tGG\tNaN\n"))
    assert dict(tab.dtypes) == {"Name": "string", "Sequence": "string", "IC50": "double"} and tab.filter("IC50 is null").count() == 1
    comma = RD.read_table(spark, _write(tmp_path, "c.txt", "Name,n\na,1\nb,2\n"))
    assert dict(comma.dtypes)["n"] == "bigint"
    assert _pairs(RD.read_table(spark, _write(tmp_path, "l.txt", "akl\n\nGIGA RR\n"))) == [("Manual_1", "AKL"), ("Manual_2", "GIGA"), ("Manual_3", "RR")]
    assert _pairs(RD.read_table(spark, _write(tmp_path, "f.txt", ">x\nAA\n"))) == [("x", "AA")]
    with pytest.raises(ValueError):
        RD.read_table(spark, "x.xlsx")


def test_fixed_schema_and_exports(spark, tmp_path):
    path = _write(tmp_path, "e.csv", "Name,Sequence,Activity,IC50,ToxicityClass,Solubility,BindingScore,ClassLabel,DockingScore\nP1,AKL,1.0,2.0,Low,0.5,3.0,Active,-4.0\n")
    table = RD.read_csv(spark, path, RD.MEASUREMENT_SCHEMA)
    assert table.first()["DockingScore"] == -4.0
    WR.write_fasta(table, str(tmp_path / "out.fa"))
    assert [r["Sequence"] for r in RD.read_fasta(spark, str(tmp_path / "out.fa")).collect()] == ["AKL"]
    WR.write_csv(table, str(tmp_path / "csv"))
    assert RD.read_csv(spark, str(tmp_path / "csv")).first()["Activity"] == 1.0
    written = WR.write_tables({"ValidatedInput": table, "Predictions": table.select("Name")}, str(tmp_path / "set"))
    assert spark.read.parquet(written[1]).columns == ["Name"]


def test_na_is_a_missing_value(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,IC50,Sequence\nx,1.5,AK\ny,NA,NA\nz,2.0,AR\n")
    found = RD.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(found.dtypes)["IC50"] == "double"
    assert [(r["IC50"], r["Sequence"]) for r in found.orderBy("Name").collect()] == [(1.5, "AK"), (None, "NA"), (2.0, "AR")]


def test_quoted_line_ends_are_read_or_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Sequence\n"x\ny",AK\n"say ""hi""",AR\n')
    with pytest.raises(ValueError, match="line ends"):
        RD.read_csv(spark, str(tmp_path / "a.csv"))
    rows = RD.read_csv(spark, str(tmp_path / "a.csv"), quoted_line_ends=True).collect()
    assert {(r["Name"], r["Sequence"]) for r in rows} == {("x\ny", "AK"), ('say "hi"', "AR")}


def test_delimiter_is_that_of_every_file(spark, tmp_path):
    for name, sep in (("a.txt", "\t"), ("b.txt", "\t")):
        (tmp_path / name).write_text(f"Name{sep}Sequence\n{name}{sep}AK\n")
    assert {r["Name"] for r in RD.read_text(spark, str(tmp_path)).collect()} == {"a.txt", "b.txt"}
    (tmp_path / "c.txt").write_text("Name;Sequence\nc;AK\n")
    with pytest.raises(ValueError, match="delimiters"):
        RD.read_text(spark, str(tmp_path))


def test_every_fasta_file_of_a_folder_starts_anew(spark, tmp_path):
    for i in range(4):
        lead = "junk before\n" if i % 2 else ""
        (tmp_path / f"f{i}.fasta").write_text(lead + f">n{i}\nAK\n>\nAR\n")
    rows = RD.read_fasta(spark, str(tmp_path)).collect()
    assert sorted((r["record"], r["Name"], r["Sequence"]) for r in rows) == sorted([(1, f"n{i}", "AK") for i in range(4)] + [(2, "Sequence_2", "AR")] * 4)
