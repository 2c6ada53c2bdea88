"""Crystals: leaders and novelty against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import crystals
from tabulon.workspace import Workspace

STRUCTURE = "struct<lattice: struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>, sites: array<struct<element:string,frac_coords:array<double>>>>"


def crystal(rng, elements="AABBC"):
    return [rng.uniform(4, 9) for _ in range(3)], [90.0, rng.choice([90.0, 101.0]), 120.0], list(elements), np.array([[rng.random() for _ in range(3)] for _ in elements])


def moved(rng, c, noise=0.003):
    lengths, angles, elements, x = c
    shift = np.array([rng.random() for _ in range(3)])
    x = (x + shift + np.array([[rng.uniform(-noise, noise) for _ in range(3)] for _ in x])) % 1
    p = rng.sample(range(len(elements)), len(elements))
    scale = 1 + rng.uniform(-0.006, 0.006)
    return [v * scale for v in lengths], angles, [elements[i] for i in p], x[p]


def struct(c):
    lengths, angles, elements, x = c
    return ((*map(float, lengths), *map(float, angles)), [(e, [float(v) for v in f]) for e, f in zip(elements, x)])


def flat(c):
    return [*c[0], *c[1]], c[2], np.asarray(c[3]).ravel()


def sequential(ids, matches):
    led = {}
    for i in sorted(ids):
        first = [j for j in sorted(set(led.values())) if (j, i) in matches]
        led[i] = first[0] if first else i
    return led


@pytest.mark.parametrize("seed", range(4))
def test_leaders_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    ids = list(range(40))
    matches = {tuple(sorted(rng.sample(ids, 2))) for _ in range(60)} | {(i, i + 1) for i in range(20, 39)}
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    pairs = spark.createDataFrame(list(matches), "a long, b long")
    got = {r["id"]: r["leader"] for r in crystals.leaders(Workspace(spark, "t"), frame, pairs).collect()}
    assert got == sequential(ids, matches)
    assert crystals.leaders(Workspace(spark, "t"), frame, pairs.limit(0)).where("id = leader").count() == 40


def test_structure_leaders(spark):
    rng = random.Random(5)
    base = [crystal(rng, e) for e in ("AABBC", "AABBC", "AB", "ABC")]
    rows = {}
    for i in range(60):
        rows[i] = (rng.choice([1, 2]), moved(rng, rng.choice(base), noise=0.012))
    data = [(i, sg, struct(c), "clash", 0) for i, (sg, c) in rows.items()] + [(100 + i, 1, struct(rows[0][1]), "", 0) for i in range(40)] + [(200, 1, None, "", 0), (201, None, struct(rows[0][1]), "", 0)]
    for i in range(40):
        rows[100 + i] = (1, rows[0][1])
    out = crystals.structure_leaders(spark.createDataFrame(data, f"i long, sg int, s {STRUCTURE}, id string, a int"), "i", "s", within="sg").collect()
    got = {r["i"]: r["leader"] for r in out}
    assert len(out) == len(data) and got[200] is None and got[201] is None
    heads = {}
    for i in sorted(rows):
        heads.setdefault((rows[i][0], str(struct(rows[i][1]))), i)
    distinct = sorted(heads.values())
    matches = {(a, b) for a, b in itertools.combinations(distinct, 2) if rows[a][0] == rows[b][0] and crystals.same_crystal(*flat(rows[a][1]), *flat(rows[b][1]))}
    led = sequential(distinct, matches)
    assert {i: got[i] for i in distinct} == led and len(set(led.values())) < len(led)
    assert all(got[100 + i] == led[heads[1, str(struct(rows[0][1]))]] for i in range(40))


def test_novelty_needs_a_structure_not_only_a_formula(spark):
    rng = random.Random(6)
    c, d = crystal(rng), crystal(rng)
    refs = spark.createDataFrame([("m1", struct(c)), ("m2", struct(moved(rng, c))), ("m3", None)], f"ref string, s {STRUCTURE}")
    cand = spark.createDataFrame([(1, struct(moved(rng, c)), True), (2, struct(d), True), (3, struct(crystal(rng, "AB")), True), (4, struct(c), None), (5, None, True)], f"i int, s {STRUCTURE}, ok boolean")
    got = {r["i"]: (r["novelty_status"], r["matches"], r["first_match"], r["reference_count"]) for r in crystals.structure_novelty(cand, refs, "i", "ref", "s", F.col("ok")).collect()}
    assert got[1] == ("matched", 2, "m1", 2) and got[2] == ("structure_novel", 0, None, 2) and got[3] == ("composition_novel", 0, None, 0)
    assert got[4][0] == got[5][0] == "not_evaluated_invalid"
    none = crystals.structure_novelty(cand, refs.limit(0), "i", "ref", "s", F.col("ok")).collect()
    assert {r["novelty_status"] for r in none} == {"composition_novel", "not_evaluated_invalid"}


def test_content_does_not_depend_on_the_order_of_sites(spark):
    rng = random.Random(7)
    c = crystal(rng)
    turned = (c[0], c[1], c[2][::-1], c[3][::-1] + 1.0)
    frame = spark.createDataFrame([(1, struct(c)), (2, struct(turned)), (3, struct(crystal(rng))), (4, None)], f"i int, s {STRUCTURE}")
    keys = {r["i"]: r["k"] for r in frame.select("i", crystals.content_key(F.col("s")).alias("k")).collect()}
    assert keys[1] == keys[2] != keys[3] and keys[4] is None
