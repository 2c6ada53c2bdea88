"""Train, validation and test splits that keep tied records together (problem 1)."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.formulas import chemical_system
from tabulon.llm.components import hooked_roots
from tabulon.operators.orphans import reference_value
from tabulon.operators.skew import heavy_keys, join_unique, running_total
from tabulon.session import table
from tabulon.workspace import Workspace

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Length of the first bitset of split totals; it grows until a total is met that can't be bettered.
BITS = 1 << 20
#: Orders of the sizes that are tried for a like share of labels.
TRIES = 24


def tied_rows(ws: Workspace, rows: DataFrame, row_id: str, share: float = 1 / 400, least: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(row_id, written, label, key) and (key, root): a row's tie and the root of the ties joined to it.

    ``rows`` has row_id, written, system, holder (a candidate value) and label. A key is ``0`` + system, else, for rows
    without one, the least system of their holder or ``1`` + holder; rows with neither have a null key and stand alone.
    Only holders of several systems join systems, so the graph to solve is over systems, however many rows there are.
    """
    holders = ws.stage(rows.where(F.col("holder").isNotNull()).groupBy("holder").agg(F.min("system").alias("low"), F.max("system").alias("high"), F.count(F.lit(1)).alias("n")))
    total = rows.count()
    fan = heavy_keys(holders, "holder", "n", total, share, least)
    joint = holders.where("low < high").select("holder", "low")
    pairs = rows.where(F.col("holder").isNotNull() & F.col("system").isNotNull()).select("holder", "system").distinct()
    links = join_unique(pairs, joint, "holder", fan).where("system != low").select(F.concat(F.lit("0"), "system").alias("a"), F.concat(F.lit("0"), "low").alias("b")).distinct()
    roots = hooked_roots(links, "a", "b", "key", "root", share, least)
    named = rows.where(F.col("system").isNotNull()).select(row_id, "written", "label", F.concat(F.lit("0"), "system").alias("key"))
    bare = join_unique(rows.where(F.col("system").isNull() & F.col("holder").isNotNull()), holders.select("holder", "low"), "holder", fan, "left")
    bare = bare.select(row_id, "written", "label", F.when(F.col("low").isNotNull(), F.concat(F.lit("0"), "low")).otherwise(F.concat(F.lit("1"), "holder")).alias("key"))
    alone = rows.where(F.col("system").isNull() & F.col("holder").isNull()).select(row_id, "written", "label", F.lit(None).cast("string").alias("key"))
    return ws.stage(named.unionByName(bare).unionByName(alone)), ws.stage(roots)


def with_root(keyed: DataFrame, roots: DataFrame, share: float = 1 / 400, least: int = 20_000) -> DataFrame:
    """keyed with the column ``root``: that of its key, or the key where it is tied to no other."""
    per_key = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    fan = heavy_keys(per_key, "key", "n", keyed.count(), share, least)
    return join_unique(keyed, roots, "key", fan, "left").withColumn("root", F.coalesce("root", "key"))


def _by_bitset(steps: list[tuple[int, int]], aim: int, goal: int) -> tuple[int, list[int]]:
    """The total closest to ``aim`` that a subset of the steps (size, number) has, and the places of that subset's steps.

    A bitset of reachable totals, up to twice the aim, is shifted by each step; each newly reached total remembers its
    step. Looking ends when ``goal`` is reached.
    """
    mask = (1 << (2 * aim + 1)) - 1
    reached, new_at = 1, []
    for i, (s, n) in enumerate(steps):
        new = (reached << (n * s)) & mask & ~reached
        if new:
            new_at.append((i, new))
            reached |= new
            if reached >> goal & 1:
                break
    low, high = (reached & ((1 << (aim + 1)) - 1)).bit_length() - 1, reached >> aim
    above = aim + (high & -high).bit_length() - 1 if high else None
    best = above if above is not None and above - aim < aim - low else low
    taken, left = [], best
    for i, new in reversed(new_at):  # a total is reached by the step that met it first, on one that was there before
        if new >> left & 1:
            taken.append(i)
            left -= steps[i][0] * steps[i][1]
    return best, taken


def _closest_subset(steps: list[tuple[int, int]], aim: int, bits: int) -> list[tuple[int, int]]:
    """Steps (size, number) whose total is as close to ``aim`` as any subset's.

    No total is closer than the multiple of the sizes' greatest common divisor next to the aim. Steps are taken in order
    while more than ``bits`` is lacking, a bitset fills the rest from the steps left; if it misses that multiple, more is
    left to a longer bitset, at last all of the aim. So the result is exact, and the usual case short.
    """
    if not steps:
        return []
    unit = math.gcd(*[s for s, _ in steps])
    goal = min((aim // unit * unit, -(-aim // unit) * unit), key=lambda t: (abs(t - aim), t))
    while True:
        lack, taken, others = aim, [], []
        for s, n in steps:
            if lack - s * n >= bits:
                taken.append((s, n))
                lack -= s * n
            else:
                others.append((s, n))
        best, places = _by_bitset(others, lack, max(0, goal - (aim - lack)))
        if aim - lack + best == goal or not taken:
            return taken + [others[i] for i in places]
        bits *= 16


def choose_counts(sizes: dict[int, int], proportions=PROPORTIONS, labels: dict[int, tuple[float, float]] | None = None, bits: int = BITS, tries: int = TRIES, seed: int = 7) -> dict[int, list[int]]:
    """For groups of each size (with their number), how many go to each split; the first split takes the rest.

    Every size first gives each split its whole proportional number. Of the groups left over, each split but the first
    takes the subset whose total comes closest to what it lacks (_closest_subset). Many subsets reach the same total:
    where labels differ, ``tries`` orders of the sizes are looked at and the one is taken whose share of label 1 is
    closest to that of all rows. ``labels``: by size, the sums over its groups of rows labelled 1 and of rows with a label.
    """
    total = sum(s * m for s, m in sizes.items())
    labels = labels or {}
    per_group = {s: (labels.get(s, (0, 0))[0] / m, labels.get(s, (0, 0))[1] / m) for s, m in sizes.items()}
    known = sum(b for _, b in labels.values())
    overall = sum(a for a, _ in labels.values()) / known if known else 0.0
    counts = {s: [0] * len(proportions) for s in sizes}
    left = dict(sizes)
    for s, m in sizes.items():
        for k, (_, share) in enumerate(proportions[1:], 1):
            counts[s][k] = int(m * share + 1e-9)
            left[s] -= counts[s][k]
    for k, (_, share) in enumerate(proportions[1:], 1):
        lack = round(total * share) - sum(s * c[k] for s, c in counts.items())
        if lack <= 0:
            continue
        steps = []
        for s, free in left.items():
            take = 1
            while free > 0 and s <= 2 * lack:
                n = min(take, free)
                steps.append((s, n))
                free -= n
                take *= 2
        # sizes with the share of labels that the split still wants tend to come early, ever less so
        ones, have = (sum(c[k] * per_group[s][j] for s, c in counts.items()) for j in (0, 1))
        more = lack * known / total
        want = (overall * (have + more) - ones) / more if more else overall
        away = {s: abs(per_group[s][0] / per_group[s][1] - want) if per_group[s][1] else want for s in left}
        best = None
        for t in range(tries if 0 < overall < 1 else 1):
            dice = random.Random(f"{seed}-{k}-{t}")
            steps.sort(key=lambda x: (away[x[0]] + dice.random() * t / tries, x))
            taken = _closest_subset(steps, lack, bits)
            got = {s: c[k] for s, c in counts.items()}
            for s, n in taken:
                got[s] += n
            ones, have = (sum(n * per_group[s][j] for s, n in got.items()) for j in (0, 1))
            off = abs(sum(s * n for s, n in got.items()) / total - share) + (abs(ones / have - overall) if have else 0.0)
            if best is None or off < best[0]:
                best = off, taken
        for s, n in best[1]:
            counts[s][k] += n
            left[s] -= n
    for s, m in sizes.items():
        counts[s][0] = m - sum(counts[s][1:])
    return counts


def split_rows(spark: SparkSession, rows: DataFrame, row_id: str, proportions=PROPORTIONS, bits: int = BITS) -> DataFrame:
    """(row_id, written, group_id, split) for every row; tied rows share a split.

    Rows: row_id, written, system, holder, label (0, 1 or null). Split totals come as close to the proportions as whole
    groups allow (choose_counts); within a size, groups are taken evenly along their share of label 1, so that shares of
    labels stay comparable. A group larger than what a split wants goes to the first split. Sizes with their numbers, at
    most about sqrt(2 rows) of them, are all that reaches the driver. Empty input gives no rows.
    """
    ws = Workspace(spark, "splits")
    keyed, roots = tied_rows(ws, ws.stage(rows), row_id)
    rooted = ws.stage(with_root(keyed, roots).select(row_id, "written", "label", F.coalesce("root", F.concat(F.lit("2"), F.col(row_id).cast("string"))).alias("group_id")))
    groups = rooted.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("label") == 1).alias("hits"), F.count_if(F.col("label").isin(0, 1)).alias("known"))
    groups = ws.stage(groups.withColumn("ones", F.coalesce(F.try_divide("hits", "known"), F.lit(-1.0))))
    by_size = groups.groupBy("size").agg(F.count(F.lit(1)), F.sum("hits"), F.sum("known")).collect()
    sizes = {r[0]: r[1] for r in by_size}
    counts = choose_counts(sizes, proportions, {r[0]: (r[2], r[3]) for r in by_size}, bits)
    names = [n for n, _ in proportions]
    plan = spark.createDataFrame([(s, sizes[s], c[1:]) for s, c in counts.items()], "size bigint, number bigint, take array<bigint>")
    ranked = running_total(ws, groups, ["size"], ["ones", "group_id"], F.lit(1), "place")
    chosen = ranked.join(F.broadcast(plan), "size").withColumn("i", F.col("place").cast("bigint")).withColumn("m", F.col("number"))
    split = F.lit(None).cast("string")
    for k, name in enumerate(names[1:]):
        take = F.col("take")[k]
        start = F.pmod(F.xxhash64("size", F.lit(k)), F.lit(1000)) / 1000.0  # else the last of few equal groups would always be the one taken
        m = F.greatest(F.col("m"), F.lit(1))
        upto, before = F.floor(F.col("i") * take / m + start), F.floor((F.col("i") - 1) * take / m + start)
        hit = (upto > before) & F.col("split").isNull() if k else (upto > before)
        chosen = chosen.withColumn("split", F.when(hit, F.lit(name)).otherwise(F.col("split") if k else split))
        # later splits number the groups that are still free
        chosen = chosen.withColumn("i", F.col("i") - upto).withColumn("m", F.col("m") - take)
    chosen = ws.stage(chosen.select("group_id", F.coalesce("split", F.lit(names[0])).alias("split"), "size"))
    fan = heavy_keys(chosen, "group_id", "size", rooted.count())
    return join_unique(rooted.select(row_id, "written", "group_id"), chosen.select("group_id", "split"), "group_id", fan).select(row_id, "written", "group_id", "split")


def oof_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "particle_dp_oof_predictions").select(
        "oof_row_id", F.col("chemical_system").alias("written"), chemical_system(F.col("chemical_system")).alias("system"), reference_value("candidate_id").alias("holder"), "label"
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of groups, placed in one split as a whole, in which the system is written in at least two ways, with the group's smallest system."""
    ws = Workspace(spark, "systems")
    placed = ws.stage(split_rows(spark, oof_rows(spark, folder), "oof_row_id"))
    groups = placed.groupBy("group_id").agg(F.min("written").alias("low"), F.max("written").alias("high"), F.min("split").alias("first"), F.max("split").alias("last"), F.count(F.lit(1)).alias("n"))
    several = ws.stage(groups.where("low < high AND first = last").select("group_id", "n"))
    fan = heavy_keys(several, "group_id", "n", placed.count())
    met = join_unique(placed, several.select("group_id"), "group_id", fan)
    return met.select("oof_row_id", F.when(F.col("group_id").startswith("0"), F.substring("group_id", 2, 1 << 30)).alias("group_key"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its split."""
    return split_rows(spark, oof_rows(spark, folder), "oof_row_id").drop("written")


def p1_split_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, share of rows and share of label 1 of each split."""
    rows = oof_rows(spark, folder)
    placed = split_rows(spark, rows, "oof_row_id").join(rows.select("oof_row_id", "label"), "oof_row_id")
    by = placed.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("label_share"))
    total = placed.agg(F.count(F.lit(1)).alias("all_rows"))
    return by.crossJoin(F.broadcast(total)).select("split", "rows", F.round(F.col("rows") / F.col("all_rows"), 6).alias("row_share"), F.round("label_share", 6).alias("label_share"))


def p1_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """By split: whether its number of rows is its share of all rows to within a row; and the number (0) of its groups that have rows elsewhere."""
    ws = Workspace(spark, "invariants")
    placed = ws.stage(p1_splits(spark, folder))
    total = placed.count()
    torn = placed.groupBy("group_id").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low != high").select("group_id")
    elsewhere = placed.join(torn, "group_id").groupBy("split").agg(F.count_distinct("group_id").alias("torn"))
    share = spark.createDataFrame([(n, round(total * s)) for n, s in PROPORTIONS], "split string, wanted bigint")
    by = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(share), "split").join(elsewhere, "split", "left")  # one row a split
    return by.select("split", (F.abs(F.col("n") - F.col("wanted")) <= 1).alias("share_met"), F.coalesce("torn", F.lit(0)).alias("torn"))
