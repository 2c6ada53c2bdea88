"""Groups of linked records and splits that keep them together."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm.components import hooked_roots, star_groups
from tabulon.llm.splits import _closest_subset, choose_counts, split_rows, tied_rows, with_root
from tabulon.workspace import Workspace

LINK = "a string, b string, id_name string, root string, lo string"


def grouped(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def cases():
    rng = random.Random(3)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i:03}") for i in range(150)] + [("hub", "s000")] * 30
    noise = [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(110)]
    odd = [(None, "x"), ("x", None), ("y", "y"), ("z", "Z"), ("é", "e"), ("", "blank"), ("a" * 5000, "b")]
    return {"chain": chain, "star": star, "noise": noise, "odd": odd, "self": [("y", "y")], "empty": []}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("method", [star_groups, hooked_roots])
def test_groups_equal_union_find(spark, name, method):
    pairs = cases()[name]
    links = spark.createDataFrame([(a, b, "clash", "clash", "clash") for a, b in pairs], LINK)
    out = method(links, "a", "b", share=0.2, least=10).collect()  # a low bar for hot keys, so that both ways of joining run
    assert len(out) == len({r[0] for r in out})
    assert {tuple(r) for r in out} == grouped(pairs)


def test_counts_hit_the_proportions():
    sizes = {1: 300, 2: 41, 7: 9, 50: 3, 130: 1}
    counts = choose_counts(sizes)
    total = sum(s * m for s, m in sizes.items())
    for k, share in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(s * c[k] for s, c in counts.items()) - share * total) <= 1
    assert all(sum(counts[s]) == m and min(counts[s]) >= 0 for s, m in sizes.items())
    assert choose_counts({}) == {}
    assert sum(choose_counts({1000: 1})[1000]) == 1


def test_the_closest_subset_equals_brute_force():
    import itertools

    rng = random.Random(11)
    for _ in range(300):
        steps = [(rng.choice([3, 6, 9, 14, 35, 70, 101]), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 9))]
        aim = rng.randrange(1, 250)
        totals = [sum(s * n for s, n in c) for k in range(len(steps) + 1) for c in itertools.combinations(steps, k)]
        taken = _closest_subset(steps, aim, rng.choice([1, 8, 1 << 20]))
        assert abs(sum(s * n for s, n in taken) - aim) == min(abs(t - aim) for t in totals if t <= 2 * aim)
        left = list(steps)
        for t in taken:
            left.remove(t)


def test_a_hundred_thousand_sizes():
    import time

    rng = random.Random(12)
    sizes = {s: 1 + s % 3 for s in range(1, 100_001)}
    labels = {s: (rng.random() * s * m * 0.6, s * m * 0.9) for s, m in sizes.items()}
    began = time.time()
    counts = choose_counts(sizes, labels=labels)
    total = sum(s * m for s, m in sizes.items())
    assert time.time() - began < 60
    assert all(sum(s * c[k] for s, c in counts.items()) == round(total * 0.1) for k in (1, 2))


def test_small_bitsets_change_nothing():
    sizes = {997: 10, 13: 500, 1: 40}
    total = sum(s * m for s, m in sizes.items())
    for bits in (8, 256, 1 << 20):
        counts = choose_counts(sizes, bits=bits)
        assert all(sum(s * c[k] for s, c in counts.items()) == round(total / 10) for k in (1, 2))


ROWS = "row long, written string, system string, holder string, label int, size int, split string, group_id string"


def rows_of(spark, data):
    return spark.createDataFrame([(i, s, s, h, y, 9, "clash", "clash") for i, (s, h, y) in enumerate(data)], ROWS)


def test_ties_go_through_holders_and_systems(spark):
    data = [("A", "h1", 1), ("B", "h1", 0), ("B", "h2", None), (None, "h2", 1), ("C", None, 0), (None, None, 1), (None, "h9", 0), (None, "h9", 0)]
    keyed, roots = tied_rows(Workspace(spark, "t"), rows_of(spark, data), "row")
    root = {r["row"]: r["root"] for r in with_root(keyed, roots).collect()}
    assert root[0] == root[1] == root[2] == root[3] == "0A"
    assert root[4] == "0C" and root[5] is None and root[6] == root[7] == "1h9"


def test_splits_are_whole_and_balanced(spark):
    rng = random.Random(5)
    data = [(f"S{min(rng.randrange(60), rng.randrange(60))}", f"h{rng.randrange(900)}" if rng.random() < 0.15 else None, rng.choice([0, 0, 0, 1, None])) for _ in range(1200)]
    data += [(None, None, 1)] * 40
    rows = rows_of(spark, data)
    out = split_rows(spark, rows, "row").drop("written")
    got = {r["row"]: (r["group_id"], r["split"]) for r in out.collect()}
    assert len(got) == len(data) and len(set(got.values())) == len({g for g, _ in got.values()})
    n = len(data)
    held = sum(s == "test" for _, s in got.values())
    assert abs(held - n / 10) <= 2
    assert split_rows(spark, rows.limit(0), "row").count() == 0


def test_a_group_too_large_goes_to_the_first_split(spark):
    out = split_rows(spark, rows_of(spark, [("A", None, 1)] * 30 + [("B", None, 0)] * 2), "row")
    assert {r[0] for r in out.where(F.col("row") < 30).select("split").distinct().collect()} == {"train"}
