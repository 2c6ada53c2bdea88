"""Survivors, linkage, packing and mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm.linkage import expectation_maximisation, link_records, posterior
from tabulon.llm.mixing import min_cost_flow, mixed, plan_mix
from tabulon.llm.packing import limits_of, pack, packed, pieces_of
from tabulon.llm.survivors import align, consensus_of, consensus_values, distance, profile_of, single, surviving_records, tokens_of
from tabulon.llm.tokens import counter, sized, turns


def test_consensus_takes_the_common_tokens():
    assert "".join(tokens_of("TaGa_sg2_0123-final")) == "TaGa_sg2_0123-final"
    votes = [("TaGa_sg2_0123", 2.0, "1"), ("TaGa_sg2_0123_copy", 1.0, "3"), ("TaGa_sg3_0123", 1.0, "2")]
    by_weight, by_trust = consensus_of(profile_of(votes))
    assert "".join(by_weight) == "TaGa_sg2_0123" and "".join(by_trust) == "TaGa_sg2_0123_copy"
    assert align(single("", 1.0), single("", 1.0)).columns == [] and distance([], ["a", "b"]) == 2 and distance(list("abc"), list("axc")) == 1


def test_the_most_trusted_value_wins_every_column():
    rng = random.Random(3)
    for _ in range(200):
        values = list({"".join(rng.choice(["ab", "_", "7", "Xy", "12", "-"]) for _ in range(rng.randrange(1, 9))) for _ in range(6)})
        votes = [(v, float(rng.randrange(1, 4)), f"{i:03d}") for i, v in enumerate(values)]
        assert "".join(consensus_of(profile_of(votes))[1]) == values[-1]


GROUPS = "grp string, id long, ok boolean, at timestamp_ntz, name string, note string, x double, value string, weight double"


def dft(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], GROUPS)


def test_survivor_order_and_fields(spark):
    import datetime as dt

    d = [dt.datetime(2025, 1, k) for k in (1, 2, 3)]
    nan = float("nan")
    rows = [
        ("a", 1, None, d[0], "n_1", None, 1.0), ("a", 2, True, d[0], "n_1", "z", nan), ("a", 3, False, d[2], "n_1_x", "z", 2.0),
        ("b", 4, None, d[1], "q", None, nan), ("b", 5, None, d[1], "q", None, 1.0), ("c", 6, None, d[0], "p", None, None), ("c", 7, None, d[1], "p", None, None),
        ("d", 9, None, None, None, None, None), ("d", 8, None, None, None, None, None), ("e", 10, True, d[0], "one", None, 1.0), (None, 11, True, d[0], "x", "x", 1.0), (None, 12, True, d[0], "x", "x", 1.0),
    ]
    frame = dft(spark, rows)
    measured = [("name", "string"), ("note", "string"), ("x", "double")]
    out = surviving_records(spark, frame, "grp", "id", F.col("ok"), "at", ["name", "note"], measured)
    got = {r["group_id"]: (r["row_id"], r["rows"], r["consensus"]) for r in out.collect()}
    assert got == {"a": (2, 3, {"name": "n_1", "note": "z"}), "b": (5, 2, {"name": "q"}), "c": (7, 2, {"name": "p"}), "d": (8, 2, None)}
    assert surviving_records(spark, frame.limit(0), "grp", "id", F.col("ok"), "at", ["name"], measured).count() == 0


def _votes(spark, rows):
    return spark.createDataFrame(rows, "slot string, value string, weight double, latest bigint, trust string")


def test_large_groups_are_aligned_in_blocks(spark):
    from tabulon.workspace import Workspace

    rng = random.Random(6)
    rows, base = [], [f"Ab{k}Cd_sg{100 + k}_0{k}17_final" for k in range(6)]
    for k, name in enumerate(base):
        seen = {name: 6.0}
        while len(seen) < 60:
            t = tokens_of(name)
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(2)] = [rng.choice(["x", "_new", str(rng.randrange(999))])]
            seen.setdefault("".join(t), 1.0)
        rows += [(str(k), v, w, 0, f"{i:03d}") for i, (v, w) in enumerate(seen.items())]
    votes = _votes(spark, rows)
    got, whole = ({r["slot"]: (r["value"], r["trusted"]) for r in consensus_values(Workspace(spark, "t"), votes, block=n).collect()} for n in (8, 1000))
    assert got == whole and [got[str(k)][0] for k in range(6)] == base
    assert all(got[str(k)][1] == [r[1] for r in rows if r[0] == str(k)][-1] for k in range(6))


def test_a_slot_with_a_third_of_all_votes(spark):
    from tabulon.workspace import Workspace

    rows = [("hot", f"a_{i}_z", 1.0, i, f"{i:05d}") for i in range(700)] + [(f"s{i}", f"b_{j}", 1.0, j, str(j)) for i in range(700) for j in range(2)] + [("n", None, 1.0, 0, "9"), ("n", "v", 1.0, 0, "1"), ("o", None, 1.0, 0, "1")]
    got = {r["slot"]: (r["value"], r["trusted"]) for r in consensus_values(Workspace(spark, "t"), _votes(spark, rows), block=16).collect()}
    assert len(got) == 703 and got["hot"][1] == "a_699_z" and got["s5"] == ("b_0", "b_1") and got["n"] == ("v", None) and got["o"] == (None, None)


def test_em_separates_two_classes():
    patterns = [((1, 1), 90), ((1, 0), 10), ((0, 1), 40), ((0, 0), 360), ((-1, 1), 5)]
    p, m, u = expectation_maximisation(patterns, [2, 2])
    assert posterior((1, 1), p, m, u) > 0.9 > 0.1 > posterior((0, 0), p, m, u)
    assert expectation_maximisation([], [2])[0] == 0.2


RECORD = "block string, elements string, number string, spacegroup int, atoms int, energy double, c_number string, confidence double"


def _people(spark, queries, records):
    wide = lambda rows: [(x[0], x[1], x[1], *x[2:], "c", 0.0) for x in rows]
    return spark.createDataFrame(wide(queries), "query_id long, " + RECORD), spark.createDataFrame(wide(records), "record_id string, " + RECORD)


def test_links_of_every_pass(spark):
    nan = float("nan")
    q = [(1, "A", "7", 1, 4, -1.0), (2, "A", None, 1, 4, -2.0), (3, "A", None, 1, 4, -2.005), (4, "B", "7", 1, 4, None), (5, None, "7", 1, 4, -1.0), (6, "A", None, 1, 4, nan), (7, "A", "8", None, None, None), (8, "A", None, 1, 4, -5.0), (9, "A", "7", 1, 4, -5.0)]
    r = [("x", "A", "7", 1, 4, -1.0), ("y", "A", "9", 2, 4, -2.009), ("x", "A", "7", 1, 8, -3.0), ("w", "A", "8", 1, 4, None), ("v", "A", "8", 1, 4, None), (None, "A", "7", 1, 4, -1.0)]
    r += [(f"k{i}", "A", None, 1, 4, -5.0 + i * 1e-6) for i in range(50)]
    queries, records = _people(spark, q, r)
    pairs, crowds = link_records(spark, queries, records)
    got = {(x["query_id"], x["record_id"]): x for x in pairs.collect()}
    assert set(got) == {(1, "x"), (2, "y"), (3, "y"), (4, "x"), (9, "x")}
    assert {(x["query_id"], x["record_id"], x["records"], x["by"]) for x in crowds.collect()} == {(7, "v", 2, "number"), (8, "k0", 50, "energy")}
    assert abs(got[2, "y"]["apart"] - 0.009) < 1e-9 and got[4, "x"]["formula"] == 0
    assert all(0 <= x["confidence"] <= 1 for x in got.values())
    assert [df.count() for df in link_records(spark, queries.limit(0), records)] == [0, 0]


def test_the_posterior_tells_matches_from_others(spark):
    rng = random.Random(4)
    records = [(f"r{i}", f"f{i % 40}", str(i), rng.randrange(1, 6), rng.randrange(4, 9), -rng.uniform(1, 2)) for i in range(400)]
    queries, truth = [], {}
    for i in range(300):
        r = rng.choice(records)
        number = r[2] if rng.random() < 0.8 else None
        truth[i] = r[0]
        queries.append((i, r[1], number, r[3] if rng.random() < 0.95 else None, r[4], r[5] + rng.uniform(-0.004, 0.004)))
    queries += [(1000 + i, f"f{i % 40}", str(5000 + i), rng.randrange(1, 6), rng.randrange(4, 9), -rng.uniform(1, 2)) for i in range(200)]
    pairs = link_records(spark, *_people(spark, queries, records))[0].collect()
    right = [x["confidence"] for x in pairs if truth.get(x["query_id"]) == x["record_id"]]
    wrong = [x["confidence"] for x in pairs if truth.get(x["query_id"]) != x["record_id"]]
    assert len(right) > 280 and len(wrong) > 100
    assert sum(c > 0.5 for c in right) / len(right) > 0.97 and sum(c > 0.5 for c in wrong) / len(wrong) < 0.1


def test_a_number_that_a_third_of_all_records_has(spark):
    records = [(f"h{i}", f"f{i}", "1", 1, 4, -1.0 - i) for i in range(300)] + [(f"z{i}", "A", "2", 1, 4, -1.0) for i in range(300)] + [(f"o{i}", f"g{i}", str(10 + i), 1, 4, None) for i in range(300)]
    queries = [(i, f"f{i}", "1", 1, 4, None) for i in range(300)] + [(500 + i, "A", "2", 1, 4, None) for i in range(300)] + [(900, "g5", "15", 1, 4, None)]
    pairs, crowds = link_records(spark, *_people(spark, queries, records))
    assert sorted((x["query_id"], x["record_id"]) for x in pairs.collect()) == sorted([(i, f"h{i}") for i in range(300)] + [(900, "o5")])
    assert {(x["record_id"], x["records"]) for x in crowds.collect()} == {("z0", 300)} and crowds.count() == 300


def test_packing_is_whole_and_tight():
    rng = random.Random(8)
    t = np.array([rng.randrange(1, 400) for _ in range(900)] + [512] * 5)
    loss = np.array([rng.randrange(x // 2 + 1) for x in t])
    box = pack(t, loss, (512, 32, 400))
    used, n = np.bincount(box, weights=t), np.bincount(box)
    assert used.max() <= 512 and n.max() <= 32 and n.min() > 0 and np.bincount(box, weights=loss).max() <= 400
    assert len(used) <= -(-t.sum() // 512) * 1.02 + 1
    assert len(pack(np.array([], int), np.array([], int), (512, 32, 400))) == 0


def test_each_limit_binds_alone():
    rng = random.Random(9)
    few, none = np.array([rng.randrange(1, 9) for _ in range(800)]), np.zeros(800, int)
    by_segments = pack(few, none, (1000, 8, 900))
    assert (np.bincount(by_segments) <= 8).all() and by_segments.max() + 1 == 100  # 800 pieces, 8 each
    t = np.array([rng.randrange(20, 60) for _ in range(600)])
    box = pack(t, t, (1000, 100, 300))  # all tokens bear loss
    held = np.bincount(box, weights=t)
    assert held.max() <= 300 and len(held) <= -(-t.sum() // 300) * 1.05
    mixed_loss = np.where(np.arange(600) % 2, t, 0)
    box = pack(t, mixed_loss, (1000, 100, 300))  # pieces without loss fill what loss leaves
    assert np.bincount(box, weights=mixed_loss).max() <= 300 and np.bincount(box, weights=t).max() <= 1000
    assert box.max() + 1 <= -(-mixed_loss.sum() // 300) * 1.1
    box = pack(np.array([100, 90, 10, 5]), np.array([100, 20, 0, 0]), (110, 9, 50))
    assert box[0] == box[2] and box[1] == box[3] != box[0]  # a piece over the limit on loss is alone but for pieces without loss


def test_sharded_packing_costs_little(spark):
    rng = random.Random(10)
    rows = [("w", 512, i, 0, 0, t, rng.randrange(t // 2, t + 1)) for i in range(3000) for t in [min(512, int(rng.expovariate(1 / 120)) + 1)]]
    pieces = spark.createDataFrame(rows, "window_name string, capacity int, doc_id long, piece int, first_token int, tokens int, loss_tokens int")
    limit = limits_of(pieces)
    assert limit["w"][0] == 512 > limit["w"][2] and 2 <= limit["w"][1] < 20
    whole = packed(spark, pieces, limit, shard=10**6).select("container_id").distinct().count()
    parts = packed(spark, pieces, limit, shard=300)
    assert parts.count() == 3000 and parts.select("container_id").distinct().count() <= whole * 1.02
    per = parts.groupBy("container_id").agg(F.sum("tokens"), F.count("doc_id"), F.sum("loss_tokens"), F.max("loss_tokens")).collect()
    assert all(t <= 512 and n <= limit["w"][1] and (el <= limit["w"][2] or most > limit["w"][2]) for _, t, n, el, most in per)


def test_pieces_cut_only_what_is_too_large(spark):
    sizes = spark.createDataFrame([(1, [300, 900], [False, True]), (2, [512], [True]), (3, [5], [False])], "doc_id long, sizes array<int>, loss array<boolean>")
    rows = [tuple(r)[2:] for r in pieces_of(sizes, [("w", 512)]).orderBy("doc_id", "piece").collect()]
    assert rows == [(1, 0, 0, 512, 212), (1, 1, 512, 512, 512), (1, 2, 1024, 176, 176), (2, 0, 0, 512, 512), (3, 0, 0, 5, 0)]
    out = packed(spark, pieces_of(sizes, [("w", 512)]), shard=2)
    per = out.groupBy("container_id").agg(F.sum("tokens").alias("t")).collect()
    assert sum(r["t"] for r in per) == 1717 and max(r["t"] for r in per) <= 512 and out.count() == 5
    assert packed(spark, pieces_of(sizes.limit(0), [("w", 512)])).count() == 0


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "User: hi\nAgent: hello there", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x"), (5, "word " * 20000, "x")], "doc_id long, text string, sizes string")
    got = {r["doc_id"]: r for r in sized(docs).collect()}
    assert set(got) == {1, 4, 5} and list(got[1]["loss"]) == [False, True] and sum(got[4]["sizes"]) > 1 and sum(got[5]["sizes"]) >= 20000
    assert turns("plain") == [("plain", True)] and counter()("two words") == 2
    with pytest.raises(ValueError):
        counter("/nowhere")


def test_min_cost_flow_takes_the_cheap_way():
    edges = [[0, 1, 5, 0], [0, 2, 5, 4], [1, 3, 3, 1], [2, 3, 9, 1], [1, 2, 9, 0]]
    assert min_cost_flow(edges, 0, 3, 4) == 10
    assert [e[4] for e in edges] == [5, 5, 3, 7, 2]


def test_mix_repeats_no_more_than_allowed():
    flows, total = plan_mix({("a",): 100, ("b",): 1000, ("a", "b"): 50}, {"a": (0.5, 2), "b": (0.4, 1), "none": (0.1, 3)})
    into_a = sum(f for (p, s), f in flows.items() if s == "a")
    assert abs(into_a - total * 5 / 9) <= 2 and flows[("a",), "a"] <= 200 and into_a <= 300
    assert plan_mix({}, {"a": (1.0, 1)}) == ({}, 0)


def test_mixed_sources_reach_their_shares(spark):
    rng = random.Random(9)
    docs = [(i, " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(1, 60))), rng.choice("aabbbbbbc"), "clash", "clash") for i in range(600)]
    docs += [(1000 + i, docs[i][1], "c", "x", "x") for i in range(40)] + [(2000, None, "a", "x", "x"), (2001, "", "b", "x", "x"), (2002, "text", None, "x", "x"), (2003, "text", "unlisted", "x", "x"), (2004, "w " * 30000, "b", "x", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string, record string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = mixed(spark, frame, targets).collect()
    total = sum(r["tokens"] * r["uses"] for r in out)
    for s, share, most in (("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3)):
        rows = [r for r in out if r["source"] == s]
        assert max(r["uses"] for r in rows) <= most and len({r["doc_id"] for r in rows}) == len(rows)
        assert abs(sum(r["tokens"] * r["uses"] for r in rows) / total - share / 0.9) < 0.02
    assert mixed(spark, frame.limit(0), targets).count() == 0
