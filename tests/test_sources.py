"""Readers and writers on files made here."""

import pytest
from pyspark.sql import functions as F

from grainmill.operators import registry as xr
from grainmill.sources import files

XYZ = """4
Properties=species:S:1:pos:R:3:charge:R:1 energy=-12.5 free_energy=-12.75 dipole="0.0 1.0 2.0" pbc="F F F"
Er 0.0 0.0 0.0 2.0
O 1.0 0.0 0.0 -0.5
O 0.0 2.0 0.0 -0.5
N 0.0 0.0 3.0 -1.0
"""
MOL2 = """@<TRIPOS>MOLECULE
name
 2 1
@<TRIPOS>ATOM
 1 C1 0.0 0.5 1.0 C.3
 2 O1 1.0 0.0 0.0 O.2
@<TRIPOS>BOND
 1 1 2 2
"""
LOG = """TOTAL ENERGY   -1.0 Eh
 GRADIENT NORM   0.5 Eh/a
TOTAL ENERGY   -42.125 Eh
 GRADIENT NORM   0.001 Eh/a
*** GEOMETRY OPTIMIZATION CONVERGED AFTER 17 ITERATIONS ***
  12   2.0   -10.5  (HOMO)
  13         -1.25 (LUMO)
"""


def test_parquet_many_and_none(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, x string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2, 3.0)], "k int, y double").write.parquet(f"{tmp_path}/b")
    got = files.scan(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert sorted(got.columns) == ["k", "x", "y"] and got.count() == 2
    with pytest.raises(FileNotFoundError):
        files.scan(spark, [])


def test_csv_keeps_ids_and_bears_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n001234567890,1.5\n")
    (tmp_path / "e.csv").write_text("")
    rows = files.scan_csv(spark, f"{tmp_path}/a.csv", "id string, v double").collect()
    assert rows[0]["id"] == "001234567890"
    df, empty = files.scan_csvs(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/e.csv"], "id string, v double")
    assert df.count() == 1 and [p.rsplit("/", 1)[-1] for p in empty] == ["e.csv"]


def test_registry_skips_what_is_not_ok(spark, tmp_path):
    lines = ['{"spec":{"preset":"a","model":"gbt","seed":1},"key":"k","status":"ok","metrics":{"r2":0.5,"mae":0.1},"params":{"depth":"6"}}', "", "  ", '{"spec":{"pres', '{"spec":{"preset":"b"},"status":"error","error":"x"}']
    (tmp_path / "results.jsonl").write_text("\n".join(lines))
    got = files.scan_registry(spark, f"{tmp_path}/results.jsonl").collect()
    assert len(got) == 1 and got[0]["r2"] == 0.5 and got[0]["params"] == '{"depth":"6"}'


def test_record_directory(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"build_id": "a",\n "energy": 1.5}')
    (tmp_path / "r/b.json").write_text('{"build_id": ')
    good, bad = files.scan_records(spark, f"{tmp_path}/r", "build_id string, energy double")
    assert [r["build_id"] for r in good.collect()] == ["a"] and [r["file"] for r in bad.collect()] == ["b.json"]


def test_runs_need_their_predictions(spark):
    runs = spark.createDataFrame([("d/run_x.json",), ("d/run_y.json",)], "path string")
    oofs = spark.createDataFrame([("d/oof_x.parquet",)], "path string")
    assert [(r["path"], r["oof_path"]) for r in files.paired_runs(runs, oofs).collect()] == [("d/run_x.json", "d/oof_x.parquet")]


def test_extended_xyz(spark, tmp_path):
    (tmp_path / "s.xyz").write_text(XYZ)
    r = files.scan_xyz(spark, f"{tmp_path}/s.xyz").first()
    assert r["natoms"] == 4 and r["props"]["energy"] == "-12.5" and r["props"]["dipole"] == "0.0 1.0 2.0"
    assert [a["symbol"] for a in r["atoms"]] == ["Er", "O", "O", "N"] and r["atoms"][3]["z"] == 3.0
    assert sum(a["charge"] for a in r["atoms"]) == 0
    plain = spark.createDataFrame([("2\ncomment\nC 0 0 0\nO 1 2 3",), ("",)], "value string")
    a, b = files.xyz(plain).collect()
    assert a["atoms"][1]["y"] == 2 and a["atoms"][0]["charge"] is None and b["natoms"] is None


def test_xyz_round_trip(spark, tmp_path):
    df = files.xyz(spark.createDataFrame([("s", XYZ)], "key string, value string")).withColumn("header", F.lit("energy=-12.5"))
    text = files.xyz_text(df, "key")
    back = files.xyz(text).first()
    assert back["atoms"] == df.first()["atoms"] and back["props"]["energy"] == "-12.5"


def test_mol2(spark, tmp_path):
    (tmp_path / "s.mol2").write_text(MOL2)
    r = files.scan_mol2(spark, f"{tmp_path}/s.mol2").first()
    assert set(r["sections"]) == {"MOLECULE", "ATOM", "BOND"} and [a["name"] for a in r["atoms"]] == ["C1", "O1"] and r["atoms"][0]["y"] == 0.5
    assert files.mol2(spark.createDataFrame([("no sections",)], "value string")).first()["atoms"] == []


def test_log_scrape(spark):
    df = spark.createDataFrame([(LOG,), ("nothing here",)], "value string")
    a, b = files.log_scrape(df).drop("value").collect()
    assert tuple(a) == (-42.125, 0.001, True, 17, -10.5, -1.25)
    assert tuple(b) == (None, None, False, None, None, None)


def test_path_lookups(spark):
    listing = spark.createDataFrame([("a/x.xyz",), ("b/x.xyz",), ("old/y.xyz",), ("b/y.xyz",)], "path string")
    got = {r["name"]: r["path"] for r in files.first_by_name(listing, excluded="old/").collect()}
    assert got == {"x.xyz": "a/x.xyz", "y.xyz": "b/y.xyz"}
    cand = spark.createDataFrame([(1, "none", 0), (1, "b/x.xyz", 1), (1, "a/x.xyz", 2), (2, "none", 0)], "k int, path string, priority int")
    assert {r["k"]: r["path"] for r in files.resolve(cand, listing, "k").collect()} == {1: "b/x.xyz", 2: None}


def test_replace_while_reading(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    files.replace_parquet(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_append_extend_freeze_and_markdown(spark, tmp_path):
    files.append_jsonl(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/j")
    files.append_jsonl(spark.createDataFrame([(2,)], "a int"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    files.extend_table(spark, f"{tmp_path}/c", spark.createDataFrame([("x", 1)], "k string, a int"))
    out = files.extend_table(spark, f"{tmp_path}/c", spark.createDataFrame([("y", 2)], "k string, b int"))
    assert sorted((r["k"], r["a"], r["b"]) for r in out.collect()) == [("x", "1", None), ("y", None, "2")]
    files.freeze(spark.range(1), f"{tmp_path}/f")
    with pytest.raises(Exception, match="(?i)exist"):
        files.freeze(spark.range(1), f"{tmp_path}/f")
    table = files.markdown(spark.createDataFrame([("a", 0.123456), ("b", None)], "k string, v double"), ["k", "v"])
    assert table.splitlines()[2:] == ["| a | 0.1235 |", "| b |  |"]


def test_snapshots(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for n in "abc":
        (tmp_path / "s" / n).write_text(n)
    before = spark.createDataFrame(xr.snapshot(spark, f"{tmp_path}/s").collect())
    (tmp_path / "s/a").write_text("edited")
    (tmp_path / "s/b").unlink()
    got = {r["path"].rsplit("/", 1)[-1]: r["state"] for r in xr.compare_snapshots(before, xr.snapshot(spark, f"{tmp_path}/s")).collect()}
    assert got == {"a": "changed", "b": "missing", "c": "same"}
