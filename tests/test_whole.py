"""Queries take all rows of their tables, also where the SQL beside them takes a part."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabulon.plans import catalogue
from tabulon.session import table

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@data
def test_every_line_item_is_expanded(spark):
    out = catalogue.QUERIES["degenerate_expand"](spark, DATA)
    wanted = [(r.l_orderkey, r.l_linenumber, k, r.l_linenumber + k) for r in table(spark, DATA, "lineitem").select("l_orderkey", "l_linenumber").collect() for k in range(r.l_linenumber)]
    assert sorted(tuple(r) for r in out.select("l_orderkey", "l_linenumber", "step", "band").collect()) == sorted(wanted)


@data
def test_every_order_gets_a_draw(spark):
    orders = [tuple(r) for r in table(spark, DATA, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").collect()]
    counts = {}
    for _, p, s in orders:
        counts.setdefault(p, {}).setdefault(s, 0)
        counts[p][s] += 1

    def drawn(key, p):
        u, below, total = (key * 7919 + 13) % 1000 / 1000.0, 0, sum(counts[p].values())
        for s in sorted(counts[p]):
            below += counts[p][s]
            if below / total > u:
                return s

    out = catalogue.QUERIES["categorical_draw"](spark, DATA).collect()
    assert sorted((r.o_orderkey, r.o_orderstatus) for r in out) == sorted((k, drawn(k, p)) for k, p, _ in orders)


CANDIDATES = "candidate_id string, atom_count int, element_count int, volume_per_atom double, density_g_cm3 double, min_distance_angstrom double"
PREDICTIONS = "oof_row_id long, candidate_id string, label int, chemical_system string, actual_spacegroup int, oof_probability double"


def test_predictions_meet_candidates_however_written(spark, tmp_path):
    from tabulon.plans import model_queries, resolve_queries

    more = ", catalog_row_id long, reduced_formula string, actual_spacegroup int, stoichiometry_valid boolean, condition_valid boolean, target_spacegroup_match boolean, is_unique boolean"
    rows = [("A__A_1", 4, 2, 9.0, 3.0, 2.0, 1, "A", 1, True, True, True, True), ("B__B_2", 6, 2, 9.0, 3.0, 2.0, 2, "B", 1, True, True, True, True)]
    spark.createDataFrame(rows, CANDIDATES + more).write.parquet(str(tmp_path / "structure_catalog.parquet"))
    asked = [(1, "A__A_1", 1, "A", 1, 0.8), (2, " A/A_1 ", 0, "A", 1, 0.6), (3, "B__B_2 ", 1, "B", 1, 0.9), (4, "gone", 1, "B", 1, 0.1), (5, None, 1, "B", 1, 0.1)]
    spark.createDataFrame(asked, PREDICTIONS).write.parquet(str(tmp_path / "particle_dp_oof_predictions.parquet"))
    got = {r.oof_row_id: r.atom_count for r in model_queries._features(spark, str(tmp_path)).collect()}
    assert got == {1: 4.0, 2: 4.0, 3: 6.0, 4: None, 5: None}
    scored = {r.candidate_id: (r.topology_probability, r.uncertainty) for r in resolve_queries._scored(spark, str(tmp_path)).collect()}
    assert scored == {"A__A_1": (0.7, 0.2), "B__B_2": (0.9, 0.0)}


@data
def test_every_prediction_is_scored_or_has_an_error(spark):
    out = catalogue.QUERIES["tree_uncertainty"](spark, DATA).collect()
    assert sorted(r.oof_row_id for r in out) == sorted(r.oof_row_id for r in table(spark, DATA, "particle_dp_oof_predictions").select("oof_row_id").collect())
    assert all((r.probability is None) == (r.error is not None) for r in out)


@data
def test_the_bootstrap_draws_2000_times(spark):
    from tabulon.operators import evaluate

    got = catalogue.QUERIES["group_bootstrap_ci"](spark, DATA).first()
    sizes = {}
    for g, p, y in table(spark, DATA, "particle_dp_oof_predictions").select("actual_spacegroup", "oof_probability", "label").collect():
        if g is not None and p is not None and p == p and y in (0, 1):
            n, hits, chosen, both = sizes.get(g, (0, 0, 0, 0))
            sizes[g] = (n + 1, hits + y, chosen + (p >= 0.5), both + y * (p >= 0.5))
    groups, (a, c, m) = [sizes[g] for g in sorted(sizes)], evaluate.LCG
    drawn = []
    for k in range(2000):
        picks = [groups[((i + 13) * a + c) % m * 48271 % 2147483647 % len(groups)] for i in range(k * len(groups), (k + 1) * len(groups))]
        n, hits, chosen, both = map(sum, zip(*picks))
        if hits and chosen:
            drawn.append(both / chosen / (hits / n))
    drawn.sort()

    def bound(q):
        at = q * (len(drawn) - 1)
        low = int(at)
        return drawn[low] + (at - low) * (drawn[min(low + 1, len(drawn) - 1)] - drawn[low])

    assert got["draws"] == len(drawn) > 200
    assert (got["ci_low"], got["ci_high"]) == (pytest.approx(bound(0.025), abs=2e-6), pytest.approx(bound(0.975), abs=2e-6))
    assert catalogue.QUERIES["deployment_gate"](spark, DATA).first()["ci_low"] == got["ci_low"]


def test_the_forests_have_the_surveyed_size(spark, monkeypatch):
    from tabulon.operators import learn
    from tabulon.plans import model_queries

    asked = {}
    monkeypatch.setattr(model_queries, "_features", lambda *_: None)
    monkeypatch.setattr(learn, "out_of_fold", lambda *_, **k: asked.update(oof=k))
    monkeypatch.setattr(learn, "scored_with_uncertainty", lambda *_, **k: asked.update(spread=k))
    model_queries.rf_oof_scores(spark, DATA)
    model_queries.tree_uncertainty(spark, DATA)
    assert asked == {"oof": {"folds": 5, "trees": 600}, "spread": {"trees": 600}}


def test_spread_over_trees_equals_each_tree_asked(spark):
    import random

    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from tabulon.operators import learn

    rng = random.Random(5)
    rows = [(k, int(rng.random() < (0.8 if k % 7 < 3 else 0.3)), float(k % 7), rng.random()) for k in range(400)] + [(400, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double").coalesce(1)
    got = {r.id: r for r in learn.scored_with_uncertainty(spark, df, "id", "label", ["a", "b"], trees=9).collect()}
    ready, _ = learn.assembled(df, ["a", "b"])
    model = learn.forest("label", 9, 20).fit(learn.weighted(ready.select(F.col("label").cast("double").alias("label"), "features"), "label"))
    each = [dict(t.transform(ready).select("id", vector_to_array("probability")[1]).collect()) for t in model.trees]
    assert got.pop(400).error == "unusable feature" and len(got) == 400
    for k, r in got.items():
        votes = [e[k] for e in each]
        assert (r.probability, r.uncertainty) == (pytest.approx(np.mean(votes)), pytest.approx(np.std(votes)))
