"""Connected components of a table of links, by two methods that only join and aggregate.

``star_groups`` rewrites edges until they are stars (problem 6); ``hooked_roots`` works on parent arrays held as tables
(problem 1). Both stage every round in the shared folder and stop when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.skew import heavy_keys, join_unique, ordered_ids
from tabulon.workspace import Workspace


def _numbered(ws: Workspace, links: DataFrame, left: str, right: str, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct links as (hi, lo) of ordered bigint ids, and the table of (value, id). Ends with many links are met by broadcast."""
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    pairs = ws.stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = ordered_ids(ws, pairs.select(F.explode(F.array("a", "b")).alias("value")), "value", "id")
    total, edges = pairs.count(), pairs
    for end, name in (("a", "hi"), ("b", "lo")):
        fan = heavy_keys(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")), end, "n", total, share, least)
        edges = join_unique(edges, nodes.select(F.col("value").alias(end), F.col("id").alias(name)), end, fan)
    edges = ws.stage(edges.select("hi", "lo"))
    ws.drop(pairs)
    return edges, nodes


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def star_groups(links: DataFrame, left: str, right: str, id_name: str = "record_id", group_name: str = "group_id", share: float = 1 / 400, least: int = 20_000) -> DataFrame:
    """Every value linked to another one, with the smallest value linked to it directly or indirectly.

    Large-star: each node passes its least neighbour on to its greater neighbours. Small-star: each node links its
    lesser neighbours, and itself, to the least of them. Alternated until unchanged, every node hangs on the least of
    its component. Each star is a grouped minimum (combined before the shuffle) joined back to the edges; nodes with a
    large share of all edges are met by broadcast, at most 1 / share of them.

    Links with a null end or equal ends link nothing; repeated and reversed links count once; no links give no rows.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "stars")
    edges, nodes = _numbered(ws, links, left, right, share, least)
    mark = _mark(edges)
    while True:
        total = mark[0]
        # large-star
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least_of = ws.stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"), F.count(F.lit(1)).alias("n")))
        heavy = heavy_keys(least_of, "node", "n", total, share, least)
        large = join_unique(edges.withColumnRenamed("lo", "node"), least_of.select("node", "low"), "node", heavy).select("hi", F.col("low").alias("lo")).distinct()
        large = ws.stage(large)
        # small-star
        low_of = ws.stage(large.groupBy("hi").agg(F.min("lo").alias("low"), F.count(F.lit(1)).alias("n")))
        heavy = heavy_keys(low_of, "hi", "n", total, share, least)
        met = join_unique(large, low_of.where("n > 1").select("hi", "low"), "hi", heavy)
        small = met.where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).unionByName(low_of.select("hi", F.col("low").alias("lo"))).distinct()
        after = ws.stage(small)
        ws.drop(edges, least_of, large, low_of)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    # every edge now joins a node to its component's least one
    roots = edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
    named = nodes.select("id", F.col("value").alias(id_name)).join(roots, "id")
    heads = edges.select(F.col("lo").alias("root")).distinct().join(nodes.select(F.col("id").alias("root"), F.col("value").alias(group_name)), "root")
    sizes = edges.groupBy("lo").agg(F.count(F.lit(1)).alias("n"))
    hot = heavy_keys(sizes, "lo", "n", mark[0], share, least)
    return join_unique(named.drop("id"), heads, "root", hot).select(id_name, group_name)


def hooked_roots(links: DataFrame, left: str, right: str, id_name: str = "record_id", root_name: str = "root", share: float = 1 / 400, least: int = 20_000) -> DataFrame:
    """Every value linked to another one, with the least value of its component, over parent tables.

    Each node has a parent, at first itself. A round hooks: every root that has links hooks onto the least root among its
    neighbours if that is less; then shortcuts: parents become grandparents until all point to roots; then links are
    contracted to links between roots. It ends when no link is left. Edge cases as for star_groups.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "hooks")
    edges, nodes = _numbered(ws, links, left, right, share, least)
    parents = nodes.select("id", F.col("id").alias("parent"))
    while (total := edges.count()) > 0:
        both = edges.select(F.col("hi").alias("id"), F.col("lo").alias("other")).unionByName(edges.select(F.col("lo").alias("id"), F.col("hi").alias("other")))
        forest = ws.stage(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("parent")))
        while True:  # shortcutting: at most log2 of the deepest tree
            up = forest.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            fan = heavy_keys(forest.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n", 2 * total, share, least)
            jumped = ws.stage(join_unique(forest, up, "parent", fan).select("id", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            ws.drop(forest)
            forest = jumped.drop("moved")
            forest._staged_at = jumped._staged_at
            if not jumped.where("moved").limit(1).count():
                break
        fan = heavy_keys(parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n", 2 * total, share, least)
        moved = join_unique(parents, forest.select(F.col("id").alias("parent"), F.col("parent").alias("top")), "parent", fan, "left")
        after = ws.stage(moved.select("id", F.coalesce("top", "parent").alias("parent")))
        tops = forest.select("id", "parent")
        for end in ("hi", "lo"):
            fan = heavy_keys(edges.groupBy(end).agg(F.count(F.lit(1)).alias("n")), end, "n", 2 * total, share, least)
            edges = join_unique(edges, tops.select(F.col("id").alias(end), F.col("parent").alias(f"{end}_top")), end, fan).drop(end).withColumnRenamed(f"{end}_top", end)
        contracted = ws.stage(edges.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
        ws.drop(forest, parents)
        parents, edges = after, contracted
    fan = heavy_keys(parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n", max(1, nodes.count()), share, least)
    named = parents.join(nodes.select("id", F.col("value").alias(id_name)), "id")
    return join_unique(named, nodes.select(F.col("id").alias("parent"), F.col("value").alias(root_name)), "parent", fan).select(id_name, root_name)


def p6_links(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    matched = pairs.where("is_match").select(F.col("left_candidate_id").alias("a"), F.col("right_candidate_id").alias("b"))
    return matched.unionByName(catalog.where(F.col("duplicate_of").isNotNull()).select(F.col("candidate_id").alias("a"), F.col("duplicate_of").alias("b")))


def p6_found(spark, folder: str) -> DataFrame:
    """Every id in a group of at least two linked ids, with the smallest id of the group."""
    from tabulon.session import table

    links = p6_links(table(spark, folder, "structure_catalog"), table(spark, folder, "structure_match_pairs"))
    return star_groups(links, "a", "b", "candidate_id", "group_id")


def p6_group_sizes(spark, folder: str) -> DataFrame:
    """Number of groups of each size."""
    return p6_found(spark, folder).groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).groupBy("members").agg(F.count(F.lit(1)).alias("groups"))
