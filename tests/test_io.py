"""Files in and out, and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.sources import io
from tabulon.streaming.resume import process_new_files, windowed_rates


def test_csv_with_mark_and_last_row_of_a_key(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿id,v\r\n1,a\r\n2,\r\n1,b\r\n,c\r\n", encoding="utf-8")
    assert {tuple(r) for r in io.read_csv_keyed(spark, str(path), "id int, v string", "id").collect()} == {(1, "b"), (2, None)}
    assert io.read_csv_keyed(spark, None, "id int, v string", "id").count() == 0
    assert io.read_csv_keyed(spark, str(tmp_path / "none.csv"), "id int, v string", "id").count() == 0


def test_splits_keep_the_first(spark, tmp_path):
    for name, rows in (("train", "m1,1\n,2\n"), ("val", "m1,3\nm2,4\n,5\n")):
        (tmp_path / f"{name}.csv").write_text("material_id,x\n" + rows)
    paths = {s: str(tmp_path / f"{s}.csv") for s in ("train", "val")}
    rows, report = io.read_splits(spark, paths, "material_id string, x int", "material_id", F.col("x") != 2)
    assert {(r["material_id"], r["x"], r["split"]) for r in rows.collect()} == {("m1", 1, "train"), ("m2", 4, "val"), (None, 5, "val")}
    assert {tuple(r) for r in report.collect()} == {("train", 2, 1, 0), ("val", 3, 0, 1)}
    # a row that can't be read doesn't take the key
    rows, _ = io.read_splits(spark, paths, "material_id string, x int", "material_id", F.col("x") > 1)
    assert ("m1", 3) in {(r["material_id"], r["x"]) for r in rows.collect()}
    with pytest.raises(FileNotFoundError):
        io.read_splits(spark, {"test": str(tmp_path / "test.csv")}, "material_id string", "material_id")


def test_the_last_row_over_files_is_that_of_the_last_name(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.csv").write_text("id,v\n" + "".join(f"{i},{k}-{i}\n" for i in range(200 - 40 * k)) + f"0,{k}-last\n")
    got = {r["id"]: r["v"] for r in io.read_csv_keyed(spark, str(tmp_path / "f*.csv"), "id int, v string", "id").collect()}
    assert got[0] == "4-last" and got[50] == "3-50" and got[199] == "0-199"
    assert io.read_csv_keyed(spark, "file:/nowhere/x.csv", "id int", "id").count() == 0


def test_strict_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert [r["a"] for r in io.read_jsonl(spark, str(path), "a int", strict=True).collect()] == [1, 2]
    for bad in ('{"a": 1}\n\n{"a": 2}\n', '{"a": 1}\n{"a": \n'):
        path.write_text(bad)
        with pytest.raises(Exception, match="blank line|MALFORMED|Malformed|parse"):
            io.read_jsonl(spark, str(path), "a int", strict=True).collect()


def test_generated_files_and_texts(spark, tmp_path):
    import gzip

    for p in ("a b/gen_NaCl_sg221_001.cif", "a b/gen_NaCl_sg221_001_std.cif", "c/gen_NaCl_3_sg221_002.cif", "c/gen_task5_sg194_x.cif", "gen_odd.cif", "c/notes.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    files = io.read_files(spark, str(tmp_path), "*.cif")
    got = {tuple(r)[1:] for r in io.generated_files(files.withColumn("path", F.replace("path", F.lit("%20"), F.lit(" "))), str(tmp_path)).collect()}
    assert got == {("a_b__NaCl_sg221_001", "NaCl_sg221_001", "NaCl", 221), ("c__NaCl_3_sg221_002", "NaCl_3_sg221_002", "NaCl", 221), ("c__gen_task5_sg194_x", "gen_task5_sg194_x", None, 194)}
    with gzip.open(tmp_path / "OUTCAR.gz", "wt") as f:
        f.write("a\nb")
    (tmp_path / "OUTCAR").write_bytes(b"c\xff")
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in io.read_texts(spark, str(tmp_path / "OUTCAR*")).collect()}
    assert texts == {"OUTCAR.gz": "a\nb", "OUTCAR": "c\ufffd"}


CIF = """data_x
_cell_length_a 4.0(1)
_cell_length_b 5
_cell_length_c 6
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 120
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 0 0 0.25
Cl2 0.5 0.5 0.5(2)
"""
POSCAR = "x\n2.0\n2 0 0\n0 2 0\n0 0 2\nNa Cl\n1 1\nSelective\nCartesian\n0 0 0 T T T\n1 1 1 T T T\n"


def test_structure_files(spark, tmp_path):
    for name, text in (("a.cif", CIF), ("b.vasp", POSCAR), ("c.cif", "data_x"), ("d.poscar", "no")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["structure"] for r in io.read_structures(io.read_files(spark, str(tmp_path), suffixes=(".cif", ".vasp", ".poscar"))).collect()}
    assert got["c.cif"] is None and got["d.poscar"] is None
    assert got["a.cif"]["lattice"]["a"] == 4.0 and [(s["element"], s["frac_coords"]) for s in got["a.cif"]["sites"]] == [("Na", [0, 0, 0.25]), ("Cl", [0.5, 0.5, 0.5])]
    assert got["b.vasp"]["lattice"]["a"] == 4.0 and [round(x, 9) for x in got["b.vasp"]["sites"][1]["frac_coords"]] == [0.5, 0.5, 0.5]
    assert io.input_file(str(tmp_path), "A.CIF").endswith("a.cif")
    for bad, error in (("../x.cif", ValueError), ("", ValueError), ("none.cif", FileNotFoundError)):
        with pytest.raises(error):
            io.input_file(str(tmp_path), bad)


def test_batches_of_a_remote_source(spark):
    frame = spark.createDataFrame([(f"f{i:03}",) for i in range(120)] + [("f000",), (None,)], "f string")
    batches = io.batches_of(frame, "f", 50)
    assert sorted((r["batch"], len(r["values"]), r["values"][0]) for r in batches.collect()) == [(0, 50, "f000"), (1, 50, "f050"), (2, 20, "f100")]
    rows = io.fetched(batches, lambda v: [{"id": x, "n": len(v)} for x in [*v, "f000"]], "id string, n int", "id").collect()
    assert len(rows) == 120 and {r["id"]: r["n"] for r in rows}["f000"] == 50


def test_lists_copies_and_staged_work(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "e.json").write_text("[]")
    assert io.read_list(spark, str(tmp_path / "l.json"), "a int").count() == 2
    with pytest.raises(ValueError):
        io.read_list(spark, str(tmp_path / "e.json"), "a int")
    (tmp_path / "to").mkdir()
    assert len(io.copy_files(spark, [str(tmp_path / "l.json")], str(tmp_path / "to"))) == 1 and (tmp_path / "to/l.json").exists()
    with pytest.raises(FileNotFoundError):
        io.copy_files(spark, [str(tmp_path / "none")], str(tmp_path / "to"))
    frame = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    out = io.write_before(frame, str(tmp_path / "one"), lambda df: df.where("a > 1"), str(tmp_path / "two"))
    assert out.count() == 1 and spark.read.parquet(str(tmp_path / "one")).count() == 2
    io.append_lines(frame, str(tmp_path / "done"))
    io.append_lines(frame, str(tmp_path / "done"))
    assert spark.read.json(str(tmp_path / "done")).count() == 4
    io.write_first_row_header(frame.limit(0), str(tmp_path / "h"))
    ordered = io.in_input_order(frame, "a", lambda df: df.orderBy(F.col("a").desc()))
    assert [r["a"] for r in ordered.orderBy("place").collect()] == [1, 2]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": null}\n')
    assert [r["a"] for r in io.read_jsonl(spark, str(path), "a int").collect()] == [1, None]


def test_files_variants_and_jobs(spark, tmp_path):
    for p in ("x/gen_1.cif", "x/gen_1_relaxed.cif", "y/job_2/INCAR", "y/_old/INCAR", "y/other/readme"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    files = io.read_files(spark, str(tmp_path), "gen_*.cif")
    parts = files.select(F.regexp_extract("name", r"gen_(\d+)", 1).alias("k"), F.when(F.col("name").contains("relaxed"), "relaxed").otherwise("generated").alias("v"), "name")
    assert [r["name"] for r in io.preferred_variant(parts, "k", "v", ["relaxed", "generated"]).collect()] == ["gen_1_relaxed.cif"]
    jobs = io.jobs_of(io.read_files(spark, str(tmp_path)))
    assert [r["job_directory"].rsplit("/", 1)[1] for r in jobs.collect()] == ["job_2"]
    assert all(len(r["sha256"]) == 64 for r in io.digests(files).collect())


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", None)], "x int, y string, z string")
    io.write_both(frame, str(tmp_path / "out"), ["z", "x"])
    assert io.read_csv(spark, str(tmp_path / "out/csv"), "z string, x int").first()[:] == (None, 1)
    assert spark.read.text(str(tmp_path / "out/jsonl")).first()[0] == '{"z":null,"x":1}'
    io.write_partitioned(frame, str(tmp_path / "p"), ["y"])
    assert (tmp_path / "p" / "y=a").is_dir() and io.summary_json(frame).first()[0] == '{"x":1,"y":"a","z":null}'
    io.write_csv(frame.limit(0), str(tmp_path / "empty"), ["x"])
    assert io.label_template(frame, "x", ["label"]).first()[:] == (1, "")


def test_each_file_counts_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(k, 2 * k)], "a int, b int").write.mode("append").parquet(source)
        process_new_files(spark, source, "a int, b int", lambda d: d.where("a >= 0"), out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["a"] for r in spark.read.parquet(out).collect()) == [0, 1]


def test_windowed_rates(spark):
    t = dt.datetime(2025, 1, 1)
    frame = spark.createDataFrame([(t, "k", True), (t + dt.timedelta(minutes=5), "k", None), (t + dt.timedelta(hours=2), "k", False)], "t timestamp_ntz, k string, f boolean")
    assert sorted((r["rows"], r["hits"], r["rate"]) for r in windowed_rates(frame, "t", "k", "f").collect()) == [(1, 0, 0.0), (2, 1, 0.5)]


def test_an_index_file(spark, tmp_path):
    import json

    dp, qdp = {"abbreviation": "DP", "name": "Dirac point"}, {"abbreviation": "QDP", "name": "quadratic"}
    entry = {"essential": [qdp], "accidental": [dp, qdp], "accidental_paths": {"DP": [{"line_label": "A", "path": "GX", "source_pdf_page": 8}]}}
    (tmp_path / "i.json").write_text(json.dumps({"schema_version": 1, "source": {"title": "t"}, "space_groups": {"194": {"with_soc": entry, "other": entry}, "231": {"with_soc": entry}}}))
    particles, paths = io.read_index(spark, str(tmp_path / "i.json"))
    assert sorted((r["spacegroup"], r["soc"], r["category"], r["ord"], r["abbreviation"]) for r in particles.collect()) == [(194, True, "accidental", 0, "DP"), (194, True, "accidental", 1, "QDP"), (194, True, "essential", 0, "QDP")]
    assert [tuple(r) for r in paths.collect()] == [(194, True, "DP", 0, "A", "GX", 8)]


def test_parameters_are_checked():
    from tabulon.operators.select import check_analysis

    check_analysis(0.03, 1.0, 194)
    for bad in ((1.0, 1.0, None), (-1.0, 0.03, None), (0.03, 1.0, 231)):
        with pytest.raises(ValueError):
            check_analysis(*bad)
