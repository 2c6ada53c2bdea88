"""Orphans, skew helpers, semantics, formulas, selections and series on small inputs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions import formulas, semantics, text
from tabulon.operators import dedup, evaluate, geometry, lookup, orphans, quality, resolve, sampling, select, series
from tabulon.operators.skew import heavy_keys, join_unique, ordered_ids, running_total
from tabulon.workspace import Workspace


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n) if n is not None else None


REFS = "ref_table string, ref_row_id long, key string, at timestamp_ntz, start string, end string, n string"


@pytest.mark.parametrize("least,broadcast", [(10**9, 10), (5, 10**6), (5, 0)])
def test_orphans_equal_brute_force(spark, least, broadcast):
    rng = random.Random(1)
    keys = ["hot"] * 30 + [f"k{i}" for i in range(30)] + [None]
    refs = [("t", i, rng.choice(keys), day(rng.choice([*range(60), None])), "x", "x", "x") for i in range(400)] * 2
    lives = [(rng.choice(keys), day(rng.choice([*range(60), None])), day(rng.choice([*range(60), None, None]))) for _ in range(150)]
    lives += lives[:30]
    records = spark.createDataFrame([(k, "other", a, b, "x") for k, a, b in lives], "id string, legacy string, a timestamp_ntz, b timestamp_ntz, key string")
    frame = spark.createDataFrame(refs, REFS)
    got = orphans.orphan_references(spark, frame, orphans.lives_of(records, ["id", "legacy"], "a", "b"), share=0.01, broadcast_lives=broadcast, least=least)
    alive = lambda k, t: k is not None and t is not None and any(x == k and a is not None and a <= t and (b is None or t < b) for x, a, b in lives)
    # of lives that begin together the longest counts; it covers the others
    assert sorted(r["ref_row_id"] for r in got.collect()) == sorted(r[1] for r in refs if not alive(r[2], r[3]))
    assert orphans.orphan_references(spark, frame.limit(0), orphans.lives_of(records.limit(0), ["id"], "a", "b")).count() == 0


def test_reference_values(spark):
    for given, read in ((" a/b ", "a__b"), ("\ta__b", "a__b"), ("", None), (" - ", None), ("None", None), ("nan", None), (None, None), ("none", "none")):
        assert spark.createDataFrame([(given,)], "v string").select(orphans.reference_value("v")).first()[0] == read


def test_skew_helpers(spark):
    ws = Workspace(spark, "t")
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("zz", 3)], "k string, v int")
    small = spark.createDataFrame([("a", 1), ("b", 2)], "k string, w int")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, "k", "n", 53, 0.5, 1)
    assert heavy == ["a"]
    for hot in ([], heavy):
        assert join_unique(big, small, "k", hot).count() == 51
        assert join_unique(big, small, "k", hot, "left").count() == 53
    ids = {r[0]: r[1] for r in ordered_ids(ws, spark.createDataFrame([(x,) for x in ["b", "a", "é", "Z", "a", None]], "v string"), "v", "id").collect()}
    assert sorted(ids, key=ids.get) == ["Z", "a", "b", "é"]
    rows = [(rng, i, i % 5 if i % 7 else None) for rng in ("x", "y", None) for i in range(80)]
    out = running_total(ws, spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], F.col("v"), "t", parts=5).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["t"] == sum(v or 0 for g, i, v in rows if g == r["g"] and i <= r["i"])


def test_semantics(spark):
    flags = {"TRUE ": True, "y": True, "0": False, "No": False, "maybe": None, "": None, None: None}
    for k, v in flags.items():
        assert one(spark, k, semantics.lenient_bool) is v
    assert [one(spark, k, semantics.switch_bool) for k in (".TRUE.", "t", "F", "x", None)] == [True, True, False, False, False]
    assert [one(spark, k, semantics.lenient_int) for k in ("3.9", "-2.5", "", "x", "inf", None)] == [3, -2, None, None, None, None]
    assert [one(spark, v, semantics.is_finite, "double") for v in (1.0, math.nan, math.inf, None)] == [True, False, False, False]
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), (None, 1, "n")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in semantics.last_wins(frame, ["k"], "o").collect()} == {("a", "y"), (None, "n")}
    assert spark.range(1).select(semantics.rate(F.lit(1), F.lit(0))).first()[0] is None


def test_formulas(spark):
    for given, key in (("Rb₂GeTe₃", "Ge1-Rb2-Te3"), (" Rb4 Ge2 Te6 ", "Ge1-Rb2-Te3"), ("CHCl3H", "C1-Cl3-H2"), ("", None), ("x", None), ("A0", None), (None, None), ("C99999", None)):
        assert one(spark, given, formulas.composition) == key
    for given, key in (("te/rb/ge", "Ge-Rb-Te"), ("GE-RB-TE", "Ge-Rb-Te"), ("[Te|Rb|Ge]", "Ge-Rb-Te"), ("TeGeRb", "Ge-Rb-Te"), ("\tGe-Rb-Te- ", "Ge-Rb-Te"), ("n – ca", "Ca-N"), ("N", "N"), (" - ", None), (None, None)):
        assert one(spark, given, formulas.chemical_system) == key
    names = {"ZnTl2Pt4_(28918)_SG136": ("ZnTl2Pt4", "28918", 136), "SG8-Al3Ge1Pt1Au3": ("Al3Ge1Pt1Au3", None, 8), "no563 Ta₂I P6_3m": ("Ta2I", "563", None), "Gd2AuIn3 no29584 P6_3 结果": ("Gd2AuIn3", "29584", None), "x": (None, None, None)}
    for n, (f, number, group) in names.items():
        assert (one(spark, n, formulas.formula_in_name), one(spark, n, formulas.running_number_in_name), one(spark, n, formulas.group_number_in_name)) == (f, number, group)


def test_text_functions(spark):
    assert one(spark, "1-3, 7,x,9-8", text.expand_ranges) == [1, 2, 3, 7]
    assert one(spark, "nsw = 99 ! n\n# c\nISYM=2\nNSW=0", text.settings) == {"NSW": "0", "ISYM": "2"}
    assert one(spark, "B2N", text.expanded_atoms) == ["B", "B", "N"]
    assert one(spark, r"A-\Gamma", lambda c: text.either_way(text.canonical_path(c))) == one(spark, "ΓA", lambda c: text.either_way(text.canonical_path(c)))
    assert one(spark, None, text.tokens) == [] and one(spark, " a ;; b", text.tokens) == ["a", "b"]
    assert [one(spark, n, lambda c: text.name_score(c, F.lit("NaBi结果"))) for n in ("nabi", "NaBi_sg186_007", "x-nabi", "other")] == [100, 80, 60, None]
    assert one(spark, None, lambda c: text.concept_score(c, [["gap"]])) == 0 and one(spark, "x", lambda c: text.concept_score(c, [])) == 1


def test_quality(spark):
    rows = [(True, True, True, None, None), (True, True, True, False, True), (None, True, True, True, True), (True, True, True, True, False)]
    out = quality.flag_cascade(spark.createDataFrame(rows, "p boolean, g boolean, s boolean, e boolean, f boolean"), "p", "g", "s", "e", "f").select("valid_structure", "condition_valid", "stoichiometry_valid").collect()
    assert [tuple(r) for r in out] == [(True, True, True), (True, False, False), (False, False, False), (True, True, False)]
    empty = quality.flag_counts(spark.createDataFrame([], "x boolean"), {"x": F.col("x")}).first()
    assert empty["total"] == 0 and empty["x_rate"] is None


def test_resolve(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "i int, name string")
    right = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B1"), ("b", "B2")], "k string, v string")
    out = {r["i"]: (r["v"], r["match_note"]) for r in resolve.unique_only_join(left, right, "name", "k", "v").collect()}
    assert out == {1: ("A", "matched"), 2: (None, "ambiguous"), 3: (None, "missing"), 4: (None, "missing")}
    shards = [spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "B", 1.0)], "id int, v string, w double")]
    assert {(r["id"], r["v"], r["w"]) for r in resolve.merge_shards(shards, ["id"]).collect()} == {(1, "a", None), (2, "B", 1.0)}
    e = spark.createDataFrame([("g", 1.0), ("g", math.nan), ("g", 1.05), (None, 2.0)], "g string, e double")
    got = sorted((r["r"] is not None, r["r_low"]) for r in resolve.relative_to_group_min(e, "g", F.col("e"), "r").collect() if r["g"])
    assert got == [(False, None), (True, True), (True, True)]


def test_capped_fill_equals_the_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), round(rng.random(), 1)) for i in range(60)]
    got = [r["i"] for r in select.capped_fill(spark.createDataFrame(rows, "i int, g string, s double"), ["g"], [F.col("s").desc(), F.col("i")], 4, 25).orderBy("rank").collect()]
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    first, rest, used = [], [], {}
    for r in ranked:
        used[r[1]] = used.get(r[1], 0) + 1
        (first if used[r[1]] <= 4 else rest).append(r[0])
    assert got == (first + rest)[:25]
    with pytest.raises(ValueError):
        select.check_budget(10)


def test_balanced_assignment(spark):
    frame = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "b"]), (3, ["a"]), (4, []), (5, None)], "rank int, o array<string>")
    assert {r["rank"]: r["x"] for r in select.balanced_assignment(frame, "rank", "o", "x").collect()} == {1: "a", 2: "b", 3: "a", 4: None, 5: None}


def test_series(spark):
    gaps = spark.createDataFrame([("b", i, v) for i, v in enumerate([3.0, 1.0, 1.0, 2.0, 0.5])], "g string, k int, v double")
    assert [r["k"] for r in series.local_minima(gaps, ["g"], ["k"], "v").collect()] == [2]
    swap = spark.createDataFrame([(1, "A", "B"), (2, "x", "y"), (3, "B", "A"), (4, "B", "A")], "k int, lo string, hi string").withColumn("g", F.lit(1))
    assert [r["k"] for r in series.label_exchanges(swap, ["g"], ["k"], "lo", "hi").collect()] == [2]
    points = spark.createDataFrame([("r", 9), ("r", 10), ("r", 30)], "g string, at int")
    spans = spark.createDataFrame([("r", 0, 10, 1, "one"), ("r", 10, 19, 2, "two")], "g string, a int, b int, o int, n string")
    assert [r["n"] for r in series.interval_first(points, spans, ["g"], "at", "a", "b", "o", "n").orderBy("at").collect()] == ["one", "one", None]


def test_lookup_and_evidence(spark):
    seen = spark.createDataFrame([(1, 186, "ΓA"), (2, 186, "KH"), (3, 186, "XY")], "i int, g int, path string")
    known = spark.createDataFrame([(186, r"A-\Gamma", "DP"), (186, "HK", "DP"), (186, "K-H", "TP")], "g int, known string, e string")
    out = {r["i"]: (r["path_status"], list(r["candidates"])) for r in lookup.match_paths(seen, known, ["g"], "path", "known", "e").collect()}
    assert out == {1: ("unique", ["DP"]), 2: ("ambiguous", ["DP", "TP"]), 3: ("not_indexed", [])}
    assert spark.range(1).select(lookup.gap_class(F.lit(0.006), 0.03), lookup.energy_class(F.lit(-0.49))).first()[:] == ("well_below_threshold", "within_0.5_eV_of_fermi")
    entries = spark.createDataFrame([(1, 0, 0, "DNL", []), (1, 0, 1, "net", []), (1, 1, 0, "DP", ["p"]), (1, 1, 1, "DNL", ["q"])], "g int, category_ord int, ord int, n string, paths array<string>")
    assert list(lookup.lookup(spark.createDataFrame([(1,), (2,)], "g int"), entries, ["g"], "n").orderBy("g").first()["entries"]) == ["DNL", "net", "DP"]


def test_sampling(spark):
    w = sampling.normalised_weights(spark.createDataFrame([("r", i, 0.0) for i in range(4)] + [("bad", 0, math.nan), ("bad", 1, None)], "run string, i int, lw double"), ["run"], "lw")
    assert {r["run"]: r["ess"] for r in sampling.effective_size(w, ["run"], "weight").collect()} == {"r": 4.0, "bad": 2.0}
    p = spark.createDataFrame([("r", i, x) for i, x in enumerate([0.05, 0.05, 0.1, 0.8])], "run string, i int, weight double")
    picked = [r["ancestor"] for r in sampling.systematic_resample(p, ["run"], "i", "weight", 0.37).orderBy("slot").collect()]
    assert picked == [1, 3, 3, 3]
    slots = spark.createDataFrame([("r", 0, 2), ("r", 1, 2), ("r", 2, 0)], "run string, slot int, ancestor int")
    atoms = spark.createDataFrame([("r", i // 2, v) for i, v in enumerate([0, 1, 10, 11, 20, 21])], "run string, particle int, node int")
    out = sampling.gather_blocks(slots, atoms, ["run"], "particle").groupBy("slot").agg(F.array_sort(F.collect_list("node")).alias("n")).orderBy("slot").collect()
    assert [list(r["n"]) for r in out] == [[20, 21], [20, 21], [0, 1]]


def test_geometry(spark):
    cell = "struct<lattice:struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>,sites:array<struct<element:string,frac_coords:array<double>>>>"
    frame = spark.createDataFrame([(1, ((3.0, 3.0, 3.0, 90.0, 90.0, 90.0), [("A", [0.0, 0.0, 0.0])])), (2, ((4.0, 4.0, 4.0, 90.0, 90.0, 90.0), [("A", [0.0, 0.0, 0.0]), ("B", [0.9, 0.0, 0.0])])), (3, None)], f"c int, s {cell}")
    near = {r["c"]: round(r["least_distance"], 6) for r in geometry.least_distance(frame, "c", "s").collect()}
    assert near == {1: 3.0, 2: 0.4}
    assert spark.range(1).select(geometry.wrap(F.lit(-0.25)), geometry.periodic_gap(F.lit(0.95), F.lit(0.05))).first()[0] == 0.75
    z = geometry.scaled(spark.createDataFrame([(1.0, 5.0), (math.nan, 5.0), (3.0, 5.0)], "x double, c double"), ["x", "c"]).orderBy("x").collect()
    assert [r["x_scaled"] for r in z] == [-1.0, 1.0, 0.0] and {r["c_scaled"] for r in z} == {0.0}


def test_duplicates_and_novelty(spark):
    rows = spark.createDataFrame([(1, "f", "h", True), (2, "f", "h", True), (3, "f", "h", None), (4, None, "h", True), (5, None, "h", True)], "i int, b string, h string, ok boolean")
    out = {r["i"]: (r["duplicate_of"], r["is_unique"]) for r in dedup.exact_duplicates(rows, ["b"], F.col("h"), "i", F.col("ok")).collect()}
    assert out == {1: (None, True), 2: (1, False), 3: (None, None), 4: (None, True), 5: (4, False)}
    v = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "b", [0.8, 0.6]), (3, "b", [0.28, 0.96]), (4, None, [1.0, 0.0]), (5, "b", None)], "i int, b string, v array<double>")
    assert {r["i"]: r["leader"] for r in dedup.leader_clusters(v, "b", "i", "v", 0.75).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    c = spark.createDataFrame([(1, "C", 5, True), (2, "C", 6, True), (3, "Na", 5, True), (4, "C", 5, None)], "i int, f string, sg int, ok boolean")
    r = spark.createDataFrame([("m", "C", 5)], "id string, f string, sg int")
    got = {x["i"]: (x["novelty_status"], x["is_novel"]) for x in dedup.novelty(c, r, "f", [("sg", "sg")], "i", "id", F.col("ok")).collect()}
    assert got == {1: ("matched", False), 2: ("structure_novel", True), 3: ("composition_novel", True), 4: ("not_evaluated_invalid", None)}


def test_ranking_metrics_on_small_cases(spark):
    frame = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (None, 1), (0.5, None)], "p double, y int")
    m = evaluate.ranking_metrics(spark, frame, "p", "y").first()
    assert (m["rows"], m["roc_auc"], m["base_rate"]) == (4, 0.875, 0.5) and m["brier"] == round((0.01 + 0.64 + 0.04 + 0.01) / 4, 6)
    assert evaluate.ranking_metrics(spark, frame.limit(0), "p", "y").first()["roc_auc"] is None
    low, high = spark.range(1).select(*evaluate.wilson(F.lit(0), F.lit(0))).first()
    assert low is None and high is None
