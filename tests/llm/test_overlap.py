"""Crystals in several splits."""

import itertools
import random

import numpy as np

from tabulon.llm.overlap import GRAM, cross_split_pairs, overlapping_rows, text_of, winnow
from tabulon.operators.crystals import reduced_lengths, same_crystal

STRUCTURE = "struct<lattice: struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>, sites: array<struct<element:string,frac_coords:array<double>>>>"
SCHEMA = f"row_id long, side string, material string, structure {STRUCTURE}, cell string, seed long, crystal string"


def crystal(rng, elements="AABBC"):
    return [rng.uniform(4, 9) for _ in range(3)], [90.0, rng.choice([90.0, 101.0]), 120.0], list(elements), np.array([[rng.random() for _ in range(3)] for _ in elements])


def moved(rng, c, noise=0.004, scale=0.004, times=None):
    lengths, angles, elements, x = c
    order = rng.sample(range(3), 3)
    k = times or rng.choice([(1, 1, 1), (1, 1, 1), (2, 1, 1), (1, 1, 2)])
    xs = np.vstack([(x + np.array(s)) / np.array(k) for s in itertools.product(*map(range, k))])
    es = elements * (k[0] * k[1] * k[2])
    ls = np.array(lengths) * np.array(k) * (1 + rng.uniform(-scale, scale))
    xs = (xs + np.array([rng.random() for _ in range(3)]) + np.array([[rng.uniform(-noise, noise) for _ in range(3)] for _ in xs])) % 1
    p = rng.sample(range(len(es)), len(es))
    return [ls[i] for i in order], [angles[i] for i in order], [es[i] for i in p], xs[p][:, order]


def struct(c):
    lengths, angles, elements, x = c
    return ((*map(float, lengths), *map(float, angles)), [(e, [float(v) for v in f]) for e, f in zip(elements, x)])


def flat(c):
    return [*c[0], *c[1]], c[2], np.asarray(c[3]).ravel()


def test_matcher_knows_moved_crystals():
    rng = random.Random(1)
    for _ in range(60):
        a = crystal(rng)
        assert same_crystal(*flat(a), *flat(moved(rng, a)))
        assert not same_crystal(*flat(a), *flat(crystal(rng)))
        b = (a[0], a[1], a[2], a[3].copy())
        b[3][0, 0] += 0.15
        assert not same_crystal(*flat(a), *flat(b))
        assert not same_crystal(*flat(a), *flat(([v * 1.05 for v in a[0]], *a[1:])))


def test_matcher_at_the_edge_of_the_tolerance():
    a = ([5.0, 6.0, 7.0], [90.0] * 3, ["A", "A", "B"], np.array([[0, 0, 0], [0.3, 0.4, 0.5], [0.7, 0.2, 0.1]]))
    near, far = a[3].copy(), a[3].copy()
    near[1, 0] += 0.039
    far[1, 0] += 0.041
    assert same_crystal(*flat(a), *flat((*a[:3], near)))  # with the origin between, both sites are within 0.02
    assert not same_crystal(*flat(a), *flat((*a[:3], far)))
    assert same_crystal(*flat(a), *flat(([5.09, 6.1, 7.1], *a[1:])))


def test_winnowing_selects_equal_hashes_from_equal_runs():
    rng = random.Random(2)
    tokens = [rng.randrange(1000) for _ in range(40)]
    assert winnow(tokens) == winnow(list(tokens))
    other = [5, 6, *tokens[10:30], 7]
    assert {h for _, h in winnow(tokens)} & {h for _, h in winnow(other)}
    assert winnow([1, 2, 3])[0][0] == 0


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = [crystal(rng, e) for e in ("AABBC", "AABBC", "AB", "ABC", "AABB") for _ in range(4)]
    rows, crystals = [], {}
    for i in range(120):
        c = moved(rng, rng.choice(base)) if i % 3 else crystal(rng, "AABBC")
        side = rng.choice(["train", "train", "eval", None])
        material = rng.choice([None, "", " ", f"m{rng.randrange(60)}"])
        crystals[i] = (side, (material or "").strip() or None, c)
        rows.append((i, side, material, struct(c), "clash", 1, "clash"))
    same = rows[1]
    rows += [(200, "eval", "m1", same[3], "x", 1, "x"), (201, "train", "none", None, "x", 1, "x"), (202, "eval", None, ((None, 1.0, 1.0, 90.0, 90.0, 90.0), []), "x", 1, "x")]
    crystals[200] = ("eval", "m1", crystals[1][2])
    got = {tuple(r) for r in cross_split_pairs(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for (i, (s, m, c)), (j, (t, n, d)) in itertools.product(crystals.items(), repeat=2):
        if s == "train" and t == "eval" and ((m and m == n) or same_crystal(*flat(c), *flat(d))):
            want.add((i, j))
    assert got == want and len(want) > 20


def test_a_row_without_structure_borrows_its_material(spark):
    rng = random.Random(6)
    c = crystal(rng)
    rows = [(1, None, "m", struct(c), "", 0, ""), (2, "train", "m", None, "", 0, ""), (3, "eval", "other", struct(moved(rng, c)), "", 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in cross_split_pairs(spark, frame).collect()] == [(2, 3)]
    assert cross_split_pairs(spark, frame.limit(0)).count() == 0


def test_any_multiple_of_a_cell_is_found(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for n, times in enumerate([(5, 1, 1), (6, 1, 1), (7, 1, 1), (1, 8, 1), (2, 3, 1), (1, 1, 11)]):
        c = crystal(rng, "AAB")
        big = moved(rng, c, noise=0.002, times=times)
        assert same_crystal(*flat(c), *flat(big)) and same_crystal(*flat(big), *flat(c))
        other = moved(rng, c, noise=0.002, times=(2, 1, 1))
        rows += [(10 * n, "train", None, struct(c), "", 0, ""), (10 * n + 1, "eval", None, struct(big), "", 0, ""), (10 * n + 2, "train", None, struct(other), "", 0, "")]
        want |= {(10 * n, 10 * n + 1)} | ({(10 * n + 2, 10 * n + 1)} if same_crystal(*flat(other), *flat(big)) else set())
    assert {tuple(r) for r in cross_split_pairs(spark, spark.createDataFrame(rows, SCHEMA)).collect()} == want and len(want) > 8


def test_a_shared_word_gives_a_seed():
    rng = random.Random(8)
    for _ in range(300):
        a = crystal(rng, rng.choice(["AB", "AABBC", "ABCDEF"]))
        b = moved(rng, a, noise=0.002, scale=0.019)
        one, two = (dict((h, p) for p, h in winnow(text_of(np.array(c[0]), c[2], np.asarray(c[3]), around))) for c, around in ((a, False), (b, True)))
        assert set(one) & set(two)
    lengths = reduced_lengths(np.array(b[0]), b[2], np.asarray(b[3]))
    assert len(lengths[0]) == 3 and GRAM == 3


def test_a_worst_case_cell_ends():
    rng = random.Random(9)
    n = 1200
    x = np.array([[rng.random(), rng.random(), rng.random()] for _ in range(n)])
    a = ([20.0, 20.0, 20.0], [90.0] * 3, ["A"] * n, x)
    assert same_crystal(*flat(a), *flat((*a[:3], (x + 0.3) % 1)))


def test_a_crystal_and_a_material_with_a_third_of_all_rows(spark):
    rng = random.Random(10)
    c, d = crystal(rng), crystal(rng, "AB")
    rows = [(i, "train", None, struct(c), "", 0, "") for i in range(150)] + [(1000 + i, "train", "hot", struct(d), "", 0, "") for i in range(150)]
    rows += [(2000, "eval", None, struct(moved(rng, c)), "", 0, ""), (2001, "eval", " hot", None, "", 0, ""), (2002, "eval", None, None, "", 0, "")]
    rows += [(3000 + i, "train", f"m{i}", struct(crystal(rng, "ABC")), "", 0, "") for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in cross_split_pairs(spark, frame).collect()}
    assert got == {(i, 2000) for i in range(150)} | {(1000 + i, 2001) for i in range(150)}
    assert {r["row_id"]: r["pairs"] for r in overlapping_rows(spark, frame).collect()} == {2000: 150, 2001: 150, 2002: None}
