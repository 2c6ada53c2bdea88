"""Plans and results that must hold when tables outgrow what their files let expect."""

from pyspark.sql import functions as F

from tabulon.operators import geometry, learn
from tabulon.plans import graph_queries

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_sites_are_never_broadcast(spark):
    plan = _plan(graph_queries.radius_graph(spark, DATA))
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_pairs_keep_columns_of_their_structure(spark):
    cell = "struct<lattice:struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>,sites:array<struct<element:string,frac_coords:array<double>>>>"
    one = spark.createDataFrame([(1, ((3.0, 4.0, 5.0, 90.0, 90.0, 90.0), [("A", [0.0, 0.0, 0.0])]), 3.5), (2, None, 9.0), (3, ((3.0, 4.0, 5.0, 90.0, 90.0, 90.0), [("A", [0.0, 0.0, 0.0])]), 4.5)], f"id int, s {cell}, reach double")
    pairs = geometry.neighbour_pairs(one, "id", "s", {"radius": F.col("reach")})
    assert pairs.columns == ["id", "radius", "i", "j", "image", "distance"] and pairs.count() == 52
    near = geometry.radius_graph(pairs, "id", F.col("radius"))
    assert {r["id"]: r["n"] for r in near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 3: 4}


def test_sites_are_never_broadcast_to_edges(spark):
    plan = _plan(graph_queries.edge_distances(spark, DATA))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_edges_meet_every_listing_of_their_sites(spark):
    m = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 2.0]]
    sites = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0], m), (1, 3, [0.0, 0.0, 0.5], m), (1, 3, [0.0, 0.0, 0.75], m), (2, None, [0.0] * 3, m), (None, 0, [0.0] * 3, m)], "id int, site int, x array<double>, m array<array<double>>")
    edges = spark.createDataFrame([(1, 0, 3, [0, 0, 1], "a"), (1, 0, 2, [0, 0, 0], "b"), (2, None, None, [0, 0, 0], "c"), (None, 0, 0, [0, 0, 0], "d"), (3, 0, 0, [0, 0, 0], "e"), (1, 3, 0, None, "f")], "id int, i int, j int, image array<int>, note string")
    out = geometry.edge_distances(edges, sites, "id")
    assert set(out.columns) == {"id", "i", "j", "image", "note", "vector", "distance"}
    assert sorted((r["note"], r["distance"]) for r in out.collect() if r["image"]) == [("a", 2.5), ("a", 2.75)]
    assert [r["distance"] for r in out.collect() if not r["image"]] == [None, None]


def test_forests_keep_the_nodes_of_rows_and_give_the_same_trees(spark):
    df = spark.range(0, 400, 1, 2).select((F.col("id") % 3 == 0).cast("double").alias("label"), F.rand(1).alias("a"), (F.col("id") % 7 + F.rand(2)).alias("b"))
    ready, _ = learn.assembled(df, ["a", "b"])
    rows = learn.weighted(ready, "label")
    forest = learn.forest("label", 4, 1)
    assert forest.getCacheNodeIds()
    trees = [f.fit(rows).toDebugString.split("\n", 1)[1] for f in (forest, learn.forest("label", 4, 1).setCacheNodeIds(False))]
    assert trees[0] == trees[1]
