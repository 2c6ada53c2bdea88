"""Reports and small relational operators on edge cases."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import lookup, particles, reports, tables
from tabulon.workspace import Workspace


def test_job_logs_take_the_last_values(spark):
    text = "free  energy   TOTEN  =  -1.0 eV\nNIONS = 2\nfree energy TOTEN = -18.0 eV\n reached required accuracy\nElapsed time (sec): 12.5"
    frame = spark.createDataFrame([(1, text, "relax"), (2, None, "relax"), (3, "nothing", "band_soc"), (4, "free energy TOTEN = --", "relax")], "i int, t string, s string")
    got = {r["i"]: r for r in reports.job_logs(frame, "t", F.col("s")).collect()}
    assert got[1]["energy_per_atom"] == -9.0 and got[1]["complete"] and got[1]["ionic_converged"] and got[1]["elapsed"] == 12.5
    assert got[2]["log_error"] == "log missing" and not got[2]["complete"] and got[2]["electronic_converged"] is None
    assert got[3]["total_energy"] is None and got[3]["ionic_converged"] is None and got[4]["total_energy"] is None and not got[4]["complete"]


def test_band_report_edges(spark):
    text = " 1 1 0.5 = lost\nknum = 3 kname= G\nk = 0.0 0.5 0.25 9.0\nbnd ndg eigval\n 1 2 -0.5 = G1+G2\nodd line = x\n*** end\n 5 1 0.5 = lost\nknum = 4 kname= X\nbnd  eigval\n 7 1 1.5= X1"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    rows = sorted(tuple(r) for r in reports.band_report(frame, "i", "t").select("knum", "bnd", "kname", "eigval", "irrep").collect())
    assert rows == [(3, 1, "G", -0.5, "G1+G2"), (3, 2, "G", -0.5, "G1+G2"), (4, 7, "X", 1.5, "X1")]


def test_a_single_job_or_an_error(spark):
    frame = spark.createDataFrame([("a", "d1", ["outir", "vasprun.xml"]), ("a", "d2", ["outir"])], "k string, job_directory string, files array<string>")
    assert reports.single_job(frame, "k", ("outir", "vasprun.xml")).first()["job_directory"] == "d1"
    with pytest.raises(Exception, match="found 2"):
        reports.single_job(frame, "k", ("outir",)).collect()
    with pytest.raises(Exception, match="found 0"):
        reports.single_job(frame, "k", ("INCAR",)).collect()


def test_names_by_grams_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("ab_1 Z") for _ in range(rng.randrange(1, 14))) for _ in range(300)] + ["NaBi_sg186_007", "", None]
    queries = ["".join(rng.choice("ab1z") for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["NaBi结果", "", "__"]
    n = spark.createDataFrame([(x,) for x in names], "n string")
    q = spark.createDataFrame(list(enumerate(queries)), "i int, q string")
    got = {(r["i"], r["n"], r["score"]) for r in lookup.named_like(Workspace(spark, "t"), n, "n", q, "i", "q").collect()}
    plain = lambda s: "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    want = {(i, x, 100 if plain(x) == plain(y) else 80 if plain(x).startswith(plain(y)) else 60) for i, y in enumerate(queries) if plain(y) for x in names if x is not None and plain(y) in plain(x)}
    assert got == want and any(x == "NaBi_sg186_007" for _, x, _ in got)
    best = lookup.best_named(lookup.named_like(Workspace(spark, "t"), n, "n", q.where("q = 'NaBi结果'"), "i", "q"), "i", "q", "n")
    assert lookup.only_best(best, "q", "n").first()["n"] == "NaBi_sg186_007"
    tied = spark.createDataFrame([(1, "q", 60, 2, "x")], "i int, q string, score int, ties long, n string")
    with pytest.raises(Exception, match="several results"):
        lookup.only_best(tied, "q", "n").collect()


def test_nearest_values_and_ties(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.5), (3, "b", 0.0), (4, "a", None), (5, "a", -9.0), (6, None, 1.0)], "i int, g string, x double")
    right = spark.createDataFrame([("a", 0.0, "p"), ("a", 2.0, "q"), ("a", 2.0, "r"), ("a", 3.0, "s"), ("a", None, "t")], "g string, x double, v string")
    assert {r["i"]: r["v"] for r in tables.nearest_value(left, right, ["g"], "x", "v", "v").collect()} == {1: "p", 2: "q", 3: None, 4: None, 5: "p", 6: None}


def test_small_operators(spark):
    one = spark.range(1)
    row = one.select(tables.notes({"a": F.lit(" "), "b": F.lit(2)}).alias("n"), tables.per_unit([F.lit(float("nan")), F.lit(4.0)], F.lit(0)).alias("z"), tables.same_set(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"))).alias("s")).first()
    assert row["n"] == "a=unknown; b=2" and row["z"] is None and row["s"]
    with pytest.raises(ValueError):
        particles.checked_scope(194, 225)
    particles.checked_scope(None, 225)
    assert tables.shortfall(spark.range(3), 5).first()["shortfall"] == 2
    xml = '<eigenvalues><array><set><set comment="spin 1"><set comment="kpoint 1"><r> 0.5 1.0 </r><r> bad </r></set></set></set></array></eigenvalues>'
    got = [tuple(r) for r in reports.band_values(spark.createDataFrame([(1, xml), (2, "x"), (3, None)], "i int, x string"), "i", "x").collect()]
    assert got == [(1, 1, 1, 1, 0.5, 1.0), (1, 1, 1, 2, None, None)]
