"""File formats, round trips and malformed input."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import checks, coverage
from corpusloom.sources import files


def test_jsonl(spark, tmp_path):
    rows = ['{"canonical_smiles": " C1 ", "embedded_smiles": "[C]<0,0,0>"}', "not json", '{"embedded_smiles": null, "geom_id": "g"}']
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.txt").write_text("ignored")
    read = files.read_jsonl(spark, str(tmp_path))
    assert files.bad_row_count(read) == 1
    got = sorted((r["canonical_smiles"], r["embedded_smiles"]) for r in files.staged(read, "t").filter("_bad is null").collect())
    assert got == [("", ""), ("C1", "[C]<0,0,0>")]
    with pytest.raises(ValueError):
        files.read_jsonl(spark)


def test_write_jsonl_replaces(spark, tmp_path):
    df = spark.range(25).select("id", F.concat(F.lit("x"), "id").alias("v"))
    for _ in range(2):
        files.write_jsonl(df, str(tmp_path / "out"), "id", rows_per_file=10)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*/*.json") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == list(range(25))
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("*/*.json")) == 10


def test_csv_prompts_and_counts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("k,a,c\nx,1, fixed \ny,2, \n")
    assert {r["key"]: r["corrected"] for r in files.read_corrections(spark, str(tmp_path / "c.csv")).collect()} == {"x": "fixed", "y": None}
    (tmp_path / "two.csv").write_text("k,a\nx,1\n")
    assert files.read_corrections(spark, str(tmp_path / "two.csv")).first()["corrected"] is None
    (tmp_path / "p.txt").write_text(" a \n\n" + "b" * 151 + "\n")
    assert [r[0] for r in files.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == ["a"]
    assert files.line_counts(spark, str(tmp_path / "p.txt")).first()["n_bytes"] == 4 + 1 + 152
    (tmp_path / "t.json").write_text('{"b": [1, 2], "a": "no list", "c": [3]}')
    assert [(r["key"], r["ids"]) for r in files.read_token_prompts(spark, str(tmp_path / "t.json"), 2).collect()] == [("a", []), ("b", [1, 2])]


def test_sdf_round_trip(spark, tmp_path):
    atom = "array<struct<sym:string,x:double,y:double,z:double>>"
    df = spark.createDataFrame([("m1", [("C", 0.5, -1.25, 3.0), ("Cl", 1.0, 2.0, -3.5)], {"mol_id": "7"}), ("m2", [("O", 0.0, 0.0, 0.0)], {})], f"name string, atoms {atom}, props map<string,string>")
    files.write_sdf(df.coalesce(1), str(tmp_path / "out"))
    got = {r["name"]: r for r in files.read_sdf(spark, str(tmp_path / "out")).collect()}
    assert [tuple(a) for a in got["m1"]["atoms"]] == [("C", 0.5, -1.25, 3.0), ("Cl", 1.0, 2.0, -3.5)]
    assert got["m1"]["props"] == {"mol_id": "7"} and got["m2"]["n_atoms"] == 1
    (tmp_path / "bad.sdf").write_text("name\n\n\nxx\n$$$$\n")
    assert files.read_sdf(spark, str(tmp_path / "bad.sdf")).first()["atoms"] is None


def test_xyz_and_cif(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\nwater\nO 0.0 1.0 2.0\nH 1.5*^-1 0 -1\n")
    r = files.read_xyz(spark, str(tmp_path / "a.xyz")).first()
    assert r["n_atoms"] == 2 and [tuple(a) for a in r["atoms"]] == [("O", 0.0, 1.0, 2.0), ("H", 0.15, 0.0, -1.0)]
    cif = "data_x\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nC1 C 0.1(2) 0.2 0.3\nO1 O 0.4 0.5 0.6(1)\nloop_\n_other\n1\n"
    (tmp_path / "a.cif").write_text(cif)
    got = [tuple(r)[1:] for r in files.read_cif_atoms(spark, str(tmp_path / "a.cif")).collect()]
    assert got == [("C1", "C", 0.1, 0.2, 0.3), ("O1", "O", 0.4, 0.5, 0.6)]


def test_micro_and_macro_rates(spark):
    rows = [("a", True, True, None), ("a", True, False, None), ("b", True, True, None), ("b", False, True, None), ("b", False, False, None), ("b", False, True, None)]
    df = spark.createDataFrame(rows, "key string, x boolean, y boolean, error string")
    micro = {r["key"]: r["pass_percentage"] for r in checks.pass_rates(df, "key", ["x", "y"]).collect()}
    assert micro == {"a": 50.0, "b": 25.0, "ALL": pytest.approx(100 / 3, abs=1e-5)}
    assert checks.pass_rates_macro(df, "key", ["x", "y"]).first()["pass_percentage"] == 37.5
    with pytest.raises(ValueError):
        checks.fraction([])


def test_missing_distances(spark):
    nan = float("nan")
    pairs = spark.createDataFrame([("k", 0, 10, nan), ("k", 1, 10, 0.5), ("n", 0, 11, nan)], "key string, i long, j long, r double")
    low = coverage.minima(pairs)
    got = {r["key"]: r for r in coverage.covmat(low, 0.75).collect()}
    assert got["k"]["cov_r"] == 0.5 and got["k"]["mat_r"] == 0.5
    assert got["n"]["cov_r"] == 0.0 and got["n"]["mat_r"] is None
    s = coverage.summary(coverage.coverage_curve(low), coverage.matching(low)).first()
    assert s["mat_r_mean"] is None and s["cov_r_mean"] is not None
