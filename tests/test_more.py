"""Salted joins, totals, folds, resampling, lattices, element properties and model bundles on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import formulas
from tabulon.operators import evaluate, geometry, learn, sampling
from tabulon.operators.skew import heavy_keys, join_salted, running_totals
from tabulon.workspace import Workspace


def test_salted_joins_equal_plain_ones(spark):
    rng = random.Random(1)
    keys = ["hot"] * 40 + [f"k{i}" for i in range(20)] + [None]
    left = spark.createDataFrame([(rng.choice(keys), i) for i in range(300)], "k string, a int")
    right = spark.createDataFrame([(rng.choice(keys), i) for i in range(60)], "k string, b int")
    heavy = heavy_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", 300, 0.1, 5)
    assert heavy == ["hot"]
    order = lambda df: sorted(tuple(r) for r in df.select("k", "a", "b").collect())
    assert order(join_salted(left, right, "k", heavy, "a", 7)) == order(left.join(right, "k"))
    assert heavy_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", 300) == []


def test_several_totals_in_one_pass(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice(["x", None]), i, float(rng.randrange(9)), None if i % 7 == 0 else 1.0) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, i int, v double, w double")
    out = running_totals(Workspace(spark, "t"), frame, ["g"], ["i"], {"sv": F.col("v"), "sw": F.col("w")}, 5)
    got = {r["i"]: (r["sv"], r["sw"]) for r in out.collect()}
    for g, i, _, _ in rows:
        before = [r for r in rows if r[0] == g and r[1] <= i]
        assert got[i] == (sum(r[2] for r in before), sum(r[3] or 0 for r in before))
    assert out.columns == ["g", "i", "v", "w", "sv", "sw"]


def test_stratified_folds_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(f"s{min(rng.randrange(80), rng.randrange(80))}", int(rng.random() < 0.3)) for _ in range(2000)] + [(None, 1), ("x", None)]
    out = evaluate.stratified_folds(spark.createDataFrame(rows, "g string, y int"), "g", "y").collect()
    assert len(out) == len({g for g, y in rows if g and y is not None}) and {r["fold"] for r in out} == set(range(5))
    for k in range(5):
        n, p = sum(r["rows"] for r in out if r["fold"] == k), sum(r["positives"] for r in out if r["fold"] == k)
        assert abs(n - 400) < 30 and abs(p / n - 0.3) < 0.04
    few = evaluate.stratified_folds(spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("d", 0)], "g string, y int"), "g", "y").collect()
    assert {r["fold"] for r in few} == {0, 1}
    assert evaluate.stratified_folds(spark.createDataFrame([], "g string, y int"), "g", "y").count() == 0


def test_the_top_share_is_drawn_anew(spark):
    rng = random.Random(4)
    rows = [(f"g{i % 7}", round(rng.random(), 3), int(rng.random() < 0.4)) for i in range(140)]
    got = evaluate.bootstrap_top_ci(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y", draws=60).first()
    groups = [[(s, y) for g, s, y in rows if g == f"g{k}"] for k in range(7)]
    a, c, m = evaluate.LCG
    values = []
    for d in range(60):
        drawn = [x for i in range(d * 7, d * 7 + 7) for x in groups[((i + 13) * a + c) % m * 48271 % 2147483647 % 7]]
        k, hit, left = max(1, math.ceil(0.2 * len(drawn))), 0.0, max(1, math.ceil(0.2 * len(drawn)))
        for s in sorted({s for s, _ in drawn}, reverse=True):
            here = [y for t, y in drawn if t == s]
            part = min(left, len(here)) / len(here)
            hit, left = hit + sum(here) * part, left - min(left, len(here))
        base = sum(y for _, y in drawn) / len(drawn)
        if base:
            values.append(hit / k / base)
    assert got["draws"] == len(values)
    assert (got["ci_low"], got["ci_high"]) == (pytest.approx(np.quantile(values, 0.025), abs=2e-6), pytest.approx(np.quantile(values, 0.975), abs=2e-6))


def test_runs_of_any_kind_are_resampled(spark):
    rows = [("a", i, math.log(w)) for i, w in enumerate([0.05, 0.05, 0.1, 0.8])] + [(None, i, float("nan")) for i in range(3)] + [("z", 0, None)]
    w = sampling.normalised_weights(spark.createDataFrame(rows, "run string, i int, lw double"), ["run"], "lw")
    weights = {(r["run"], r["i"]): round(r["weight"], 9) for r in w.collect()}
    assert weights["a", 3] == 0.8 and weights[None, 1] == round(1 / 3, 9) and weights["z", 0] == 1.0
    out = sampling.systematic_resample(w, ["run"], "i", "weight", 0.37).collect()
    assert sorted((r["slot"], r["ancestor"]) for r in out if r["run"] == "a") == [(0, 1), (1, 3), (2, 3), (3, 3)]
    assert sorted(r["ancestor"] for r in out if r["run"] is None) == [0, 1, 2] and len(out) == 8


def test_lattices_and_sites(spark):
    rng = np.random.default_rng(5)
    cells = [rng.uniform(-1, 1, (3, 3)) + 4 * np.eye(3) for _ in range(5)]
    frame = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(cells)] + [(9, [[1.0, 0.0, 0.0]] * 3), (10, None)], "i int, m array<array<double>>")
    got = {r["i"]: r for r in geometry.lattice_logarithm(frame, "i", "m").collect()}
    for i, m in enumerate(cells):
        back = np.array(got[i]["back"]).reshape(3, 3)
        assert np.allclose(back @ back, m @ m.T) and abs(math.exp(3 * got[i]["k"][5]) - abs(np.linalg.det(m))) < 1e-6
    assert got[9]["k"] is None and 10 not in got
    sites = spark.createDataFrame([(1, [[0.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.5, 0.5, 0.5], [0.3, 0.5, 0.4]]), (2, [])], "i int, x array<array<double>>")
    assert {r["i"]: list(r["kept"]) for r in geometry.merged_sites(sites, "i", F.col("x")).collect()} == {1: [0, 2], 2: []}
    cell = "struct<lattice:struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>,sites:array<struct<element:string,frac_coords:array<double>>>>"
    one = spark.createDataFrame([(1, ((3.0, 4.0, 5.0, 90.0, 90.0, 90.0), [("A", [0.0, 0.0, 0.0]), ("B", [0.5, 0.0, 0.0])]))], f"i int, s {cell}")
    edges = spark.createDataFrame([(1, 0, 1, [1, 0, 0]), (1, 0, 7, [0, 0, 0])], "i int, a int, b int, image array<int>").select(F.col("i").alias("c"), F.col("a").alias("i"), F.col("b").alias("j"), "image")
    out = geometry.edge_distances(edges, geometry.site_table(one.withColumnRenamed("i", "c"), "c", "s"), "c").collect()
    assert [(r["distance"], [round(x, 9) for x in r["vector"]]) for r in out] == [(4.5, [4.5, 0.0, 0.0])]
    with pytest.raises(ValueError):
        geometry.schedule(spark, "cubic", 5, 0.1, 0.2)


def test_element_properties_follow_the_table(spark):
    known = formulas.element_properties({"Fe": {"mass": 55.845}})
    assert [known["H"][3:], known["He"][3:], known["Fe"][3:], known["La"][3:], known["Hf"][3:], known["Ts"][3:]] == [[1, 1], [1, 18], [4, 8], [6, 3], [6, 4], [7, 17]]
    assert known["Fe"][1] == 55.845 and abs(known["Pb"][1] - 207) < 10
    stats = formulas.composition_statistics(F.col("e"), F.col("n"))
    frame = spark.createDataFrame([(1, ["H", "O"], [2, 1]), (2, ["Xx"], [1]), (3, [], []), (4, None, None)], "i int, e array<string>, n array<int>")
    got = {r["i"]: (r["m"], r["s"]) for r in frame.select("i", stats["number_weighted_mean"].alias("m"), stats["number_std"].alias("s")).collect()}
    assert got[1] == (pytest.approx(10 / 3), pytest.approx(3.5)) and got[2] == got[3] == got[4] == (None, None)


def test_a_bundle_comes_back(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, float(i % 3 == 0), float(i % 3), rng.random()) for i in range(120)], "id long, label double, a double, b double")
    ready, _ = learn.assembled(df, ["a", "b"])
    model = learn.forest("label", 5, 1).fit(learn.weighted(ready, "label"))
    learn.save_bundle(spark, str(tmp_path / "m"), model, ["a", "b"], {"auc": 0.5, "n": 120})
    again, features, metrics = learn.load_bundle(spark, str(tmp_path / "m"))
    assert features == ["a", "b"] and metrics == {"auc": 0.5, "n": 120}
    score = lambda m: [r["prediction"] for r in m.transform(ready).orderBy("id").collect()]
    assert score(model) == score(again)
