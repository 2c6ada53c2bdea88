"""Crystals that are the same under tolerances: matcher, candidate pairs, leaders of groups and novelty.

Two crystals are compared as they are written: after choosing origin, order of axes and sites, and multiples of the cells,
lengths, angles and each site's place must agree. Candidates for comparison share their composition and a key of binned
cell lengths, so a block of many unlike crystals is never compared pair by pair.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.dedup import novelty_status
from tabulon.operators.skew import heavy_keys, join_salted, join_unique
from tabulon.workspace import Workspace


class Tolerance(NamedTuple):
    """Relative difference of lengths, degrees of angles, and share of the cell length along each axis."""

    length: float = 0.02
    angle: float = 1.0
    site: float = 0.02


def divisors(n: int) -> list[int]:
    return [k for k in range(1, n + 1) if n % k == 0]


def units_of(counts: Counter) -> int:
    """Formula units of a cell."""
    return reduce(math.gcd, counts.values())


def bin_width(tolerance: Tolerance) -> float:
    """Bins of log-lengths twice as wide as the tolerance: a length within it lies in the same bin or the nearer one beside it."""
    return 2 * -math.log(1 - tolerance.length) + 1e-6


def reduced_lengths(lengths: np.ndarray, elements: list[str], coords: np.ndarray, tolerance: Tolerance = Tolerance()) -> list[tuple[float, ...]]:
    """Sorted logarithms of the lengths of every cell the crystal may be reduced to, itself first.

    An axis may be cut into k parts if that divides the numbers of all elements and each site, moved by 1/k, comes near
    (within twice the tolerance at either end) another one of its element.
    """
    counts = Counter(elements)
    part = units_of(counts)
    names = np.array(elements)
    of = [np.flatnonzero(names == e) for e in counts]

    def repeats(axis: int, k: int) -> bool:
        step = np.zeros(3)
        step[axis] = 1 / k
        for i in sorted(of, key=len):
            d = coords[i][:, None, :] + step - coords[i][None, :, :]
            d = np.abs(d - np.round(d)).max(2)
            if not (d.min(1) <= 4 * tolerance.site).all():
                return False
        return True

    ways = [[k for k in divisors(part) if k == 1 or repeats(axis, k)] for axis in range(3)]
    cells = [k for k in itertools.product(*ways) if part % math.prod(k) == 0]
    return list(dict.fromkeys(tuple(sorted(np.log(lengths / np.array(k)).tolist())) for k in cells))


def length_bins(logs: tuple[float, ...], around: bool, tolerance: Tolerance = Tolerance()) -> Iterator[tuple[int, ...]]:
    """The bins of three log-lengths; ``around``: and those with the nearer bins beside them."""
    places = [x / bin_width(tolerance) for x in logs]
    own = [math.floor(x) for x in places]
    if not around:
        yield tuple(own)
        return
    yield from itertools.product(*[(b, b + 1 if x - b >= 0.5 else b - 1) for x, b in zip(places, own)])


def same_crystal(cell_a, elements_a, coords_a, cell_b, elements_b, coords_b, tolerance: Tolerance = Tolerance()) -> bool:
    """Whether two crystals agree within the tolerances after choosing origin, order of axes and sites and multiples of the cells.

    The cells' multiples along an axis are the divisors of the other one's number of formula units: with no common factor,
    each must repeat itself as often as the other one is multiplied.
    """
    a, b = np.asarray(cell_a, float), np.asarray(cell_b, float)
    xa, xb = np.asarray(coords_a, float).reshape(-1, 3), np.asarray(coords_b, float).reshape(-1, 3)
    ea, eb = np.array(list(elements_a)), np.array(list(elements_b))
    ca, cb = Counter(ea.tolist()), Counter(eb.tolist())
    ua, ub = units_of(ca), units_of(cb)
    if {e: n // ua for e, n in ca.items()} != {e: n // ub for e, n in cb.items()}:
        return False
    pairs = [(i, j) for i in divisors(ub) for j in divisors(ua) if math.gcd(i, j) == 1]
    for order in itertools.permutations(range(3)):
        order = list(order)
        if np.abs(a[3:] - b[3:][order]).max() > tolerance.angle + 1e-9:
            continue
        lb = b[:3][order]
        ways = [[(i, j) for i, j in pairs if abs(a[k] * i - lb[k] * j) <= tolerance.length * max(a[k] * i, lb[k] * j) + 1e-9] for k in range(3)]
        for way in itertools.product(*ways):
            ia, ib = [w[0] for w in way], [w[1] for w in way]
            if len(ea) * math.prod(ia) == len(eb) * math.prod(ib) and _sites_agree(*_repeated(ea, xa, ia), *_repeated(eb, xb[:, order], ib), tolerance.site):
                return True
    return False


def _repeated(elements: np.ndarray, coords: np.ndarray, times: list[int]) -> tuple[np.ndarray, np.ndarray]:
    shifts = list(itertools.product(*map(range, times)))
    return np.concatenate([elements] * len(shifts)), np.vstack([(coords + np.array(s)) / np.array(times) for s in shifts])


def _sites_agree(ea: np.ndarray, xa: np.ndarray, eb: np.ndarray, xb: np.ndarray, site: float) -> bool:
    """Whether one origin brings each site near one of its element. Elements are looked at one by one, the rarest first."""
    counts = Counter(ea.tolist())
    if counts != Counter(eb.tolist()):
        return False
    kinds = sorted(counts, key=lambda e: (counts[e], e))
    of_a, of_b = [xa[ea == e] for e in kinds], [xb[eb == e] for e in kinds]
    start = of_a[0][0]
    for first in of_b[0]:
        low, high = np.full(3, np.inf), np.full(3, -np.inf)
        for one, two in zip(of_a, of_b):
            d = two[None, :, :] - one[:, None, :] - (first - start)
            d -= np.round(d)
            far = np.abs(d).max(2)
            near = far <= 2 * site + 1e-9
            partner = _matching(near, far) if near.any(1).all() and near.any(0).all() else None
            if partner is None:
                break
            off = d[np.arange(len(one)), partner]
            low, high = np.minimum(low, off.min(0)), np.maximum(high, off.max(0))
        else:
            if (high - low).max() <= 2 * site + 1e-9:  # then one origin brings every site within the tolerance
                return True
    return False


def _matching(near: np.ndarray, cost: np.ndarray) -> np.ndarray | None:
    """A one-to-one choice of near partners: nearest first, then by augmenting paths found breadth first."""
    n = len(near)
    partner, taken = np.full(n, -1), np.full(n, -1)
    options = [np.flatnonzero(row) for row in near]
    options = [o[np.argsort(cost[i, o], kind="stable")] for i, o in enumerate(options)]
    for i in range(n):
        for j in options[i]:
            if taken[j] < 0:
                partner[i], taken[j] = j, i
                break
    for i in np.flatnonzero(partner < 0):
        came, queue, end = {}, [i], -1
        while queue and end < 0:
            nxt = []
            for k in queue:
                for j in options[k]:
                    if j not in came:
                        came[j] = k
                        if taken[j] < 0:
                            end = j
                            break
                        nxt.append(taken[j])
                if end >= 0:
                    break
            queue = nxt
        if end < 0:
            return None
        while end >= 0:
            k = came[end]
            before = partner[k]
            partner[k], taken[end] = end, k
            end = before if k != i else -1
    return partner


def flattened(df: DataFrame, structure: str) -> DataFrame:
    """df with cell (six numbers), elements and coords (flat) of a structure and ``sound``: whether they can be compared.

    Structures without sites, or with a null length, angle, element or coordinate, or a length that isn't positive, can't.
    """
    lattice = F.array(*[F.col(f"{structure}.lattice.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")])
    flat = df.withColumns({"cell": lattice, "elements": F.col(f"{structure}.sites.element"), "coords": F.flatten(F.transform(f"{structure}.sites", lambda s: s["frac_coords"]))})
    sound = (F.size("elements") > 0) & (F.size("coords") == 3 * F.size("elements"))
    for c in ("cell", "elements", "coords"):
        sound = sound & ~F.exists(c, lambda x: x.isNull())
    sound = sound & F.forall("cell", lambda x: x > 0) & F.forall("coords", lambda x: ~F.isnan(x))
    return flat.withColumn("sound", F.coalesce(sound, F.lit(False)))


def content_key(structure: Column) -> Column:
    """A digest of a structure's lattice and sites: coordinates within [0, 1) to 6 digits, sites in order of their values."""
    place = lambda x: F.round(F.pmod(x, F.lit(1.0)), 6)
    sites = F.array_sort(F.transform(structure["sites"], lambda s: F.struct(s["element"].alias("e"), F.transform(s["frac_coords"], place).alias("x"))))
    lattice = F.transform(F.array(*[structure["lattice"][k] for k in ("a", "b", "c", "alpha", "beta", "gamma")]), lambda v: F.round(v, 6))
    return F.when(structure.isNotNull(), F.left(F.sha2(F.to_json(F.struct(lattice.alias("l"), sites.alias("s"))), 256), F.lit(12)))


def _keys(around: bool, tolerance: Tolerance):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, cell, elements, coords in zip(pdf["id"], pdf["cell"], pdf["elements"], pdf["coords"]):
                elements = list(elements)
                counts = Counter(elements)
                part = units_of(counts)
                ratio = "-".join(f"{e}{n // part}" for e, n in sorted(counts.items()))
                seen = {b for logs in reduced_lengths(np.array(cell[:3], float), elements, np.array(coords, float).reshape(-1, 3), tolerance) for b in length_bins(logs, around, tolerance)}
                out.extend((i, ratio + "|" + ",".join(map(str, b))) for b in seen)
            yield pd.DataFrame(out, columns=["id", "key"])

    return run


def matching_pairs(ws: Workspace, left: DataFrame, right: DataFrame, tolerance: Tolerance = Tolerance(), ordered: bool = False) -> DataFrame:
    """(a, b) of the ids of left and right crystals (id, cell, elements, coords) that are the same; ``ordered``: only a < b.

    No pair within the tolerances is missed: the bins of one side and those around the other side's share a key.
    """
    kind = left.schema["id"].dataType.simpleString()
    own = ws.stage(left.mapInPandas(_keys(False, tolerance), f"id {kind}, key string")).select(F.col("id").alias("a"), "key")
    around = ws.stage(right.mapInPandas(_keys(True, tolerance), f"id {kind}, key string")).select(F.col("id").alias("b"), "key")
    per = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = join_salted(own, around, "key", heavy_keys(per, "key", "n", own.count()), "a")
    pairs = ws.stage((met.where("a < b") if ordered else met).select("a", "b").distinct())
    total, dressed = pairs.count(), pairs
    for s, side in (("a", left), ("b", right)):
        fan = heavy_keys(pairs.groupBy(s).agg(F.count(F.lit(1)).alias("n")), s, "n", total)
        dressed = join_unique(dressed, side.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "elements", "coords")]), s, fan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [same_crystal(*r, tolerance=tolerance) for r in zip(pdf["cell_a"], pdf["elements_a"], pdf["coords_a"], pdf["cell_b"], pdf["elements_b"], pdf["coords_b"])]
            yield pdf.loc[keep, ["a", "b"]]

    return ws.stage(dressed.repartition("a", "b").mapInPandas(run, f"a {kind}, b {kind}"))  # one task holds few pairs, as each is costly


def leaders(ws: Workspace, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader): in order of id, each joins the first leader it matches, else becomes one. pairs: matching (a, b), a < b.

    The sequential rule, by rounds: an id all of whose earlier matches are known not to lead leads; one that matches a
    leader does not. Each round decides at least the least undecided id of every tangle, as a rule most of them.
    """
    kind = ids.schema["id"].dataType.simpleString()
    leading = ids.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    found, open_pairs = [ws.stage(leading)], pairs
    while True:
        told = open_pairs.join(found[-1].select(F.col("id").alias("a")), "a", "left_semi").select("b").distinct()
        told = ws.stage(told)  # these match a leader, so they don't lead
        rest = open_pairs.join(told, "b", "left_anti")
        after = ws.stage(rest.join(told.select(F.col("b").alias("a")), "a", "left_anti"))  # nor do they stand in the way
        waiting = rest.select("b").distinct()
        new = ws.stage(waiting.join(after.select("b").distinct(), "b", "left_anti").select(F.col("b").alias("id")))
        if not new.limit(1).count():
            break
        found.append(new)
        open_pairs = after.join(new.select(F.col("id").alias("b")), "b", "left_anti")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = ws.stage(every.select(F.col("id").cast(kind).alias("id")))
    first = pairs.join(every.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    lead = every.select("id", F.col("id").alias("leader"))
    return lead.unionByName(first.join(every, "id", "left_anti").select("id", "leader"))


def structure_leaders(df: DataFrame, id_: str, structure: str, tolerance: Tolerance = Tolerance(), within: str | None = None) -> DataFrame:
    """(id, leader, is_unique): each crystal's leader by ``leaders`` among those with the same ``within`` (say, space group).

    Exact copies (content_key) are compared once, through their least id. Rows without a sound structure, or a null
    ``within``, have null leader and is_unique.
    """
    ws = Workspace(df.sparkSession, "leaders")
    block = F.col(within).cast("string") if within else F.lit("")
    flat = flattened(df.select(F.col(id_).alias("id"), block.alias("block"), structure), structure)
    flat = ws.stage(flat.withColumn("content", F.when(F.col("sound") & F.col("block").isNotNull(), F.concat_ws("|", content_key(F.col(structure)), "block"))).drop(structure))
    heads = ws.stage(flat.where("content IS NOT NULL").groupBy("content").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("block", "cell", "elements", "coords")], F.count(F.lit(1)).alias("n")))
    blocks = heads.select("id", "block")
    pairs = matching_pairs(ws, heads, heads, tolerance, ordered=True)
    if within:
        a, b = blocks.select(F.col("id").alias("a"), F.col("block").alias("block_a")), blocks.select(F.col("id").alias("b"), F.col("block").alias("block_b"))
        pairs = ws.stage(pairs.join(a, "a").join(b, "b").where("block_a = block_b").select("a", "b"))
    led = heads.select("id", "content", "n").join(leaders(ws, heads.select("id"), pairs), "id")
    fan = heavy_keys(heads, "content", "n", flat.count())
    out = join_unique(flat.select("id", "content"), led.select("content", "leader"), "content", fan, "left")
    return out.select(F.col("id").alias(id_), "leader", F.when(F.col("leader").isNotNull(), F.col("leader") == F.col("id")).alias("is_unique"))


def structure_novelty(candidates: DataFrame, references: DataFrame, id_: str, ref_id: str, structure: str, valid: Column, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """Per candidate: references of its composition, matched ones (their number and least id), novelty status and whether it is new.

    A reference matches by ``same_crystal``, not by its formula alone. Candidates without a sound structure are not
    evaluated; references without one take no part.
    """
    ws = Workspace(candidates.sparkSession, "novelty")
    prepare = lambda df, key: flattened(df.select(F.col(key).alias("id"), structure, *(["__valid"] if "__valid" in df.columns else [])), structure).drop(structure)
    c = ws.stage(prepare(candidates.withColumn("__valid", F.coalesce(valid, F.lit(False))), id_))
    r = ws.stage(prepare(references, ref_id).where("sound").withColumn("cell_of", F.monotonically_increasing_id()))
    able = c.where("__valid AND sound")
    unit = lambda df: df.withColumn("composition", _ratio(F.col("elements")))
    per = unit(r).groupBy("composition").agg(F.count(F.lit(1)).alias("reference_count"))
    named = r.select("cell_of", F.col("id").alias("ref"))
    kind = c.schema["id"].dataType.simpleString()
    left = r.select(F.col("cell_of").cast("string").alias("id"), "cell", "elements", "coords")
    right = able.select(F.col("id").cast("string").alias("id"), "cell", "elements", "coords")
    hits = matching_pairs(ws, left, right, tolerance).select(F.col("a").cast("bigint").alias("cell_of"), F.col("b").cast(kind).alias("id"))
    matched = hits.join(named, "cell_of").groupBy("id").agg(F.count_distinct("ref").alias("matches"), F.min("ref").alias("first_match"))
    done = unit(c).join(per, "composition", "left").join(matched, "id", "left")
    ok = F.col("__valid") & F.col("sound")
    out = done.select(F.col("id").alias(id_), F.when(ok, F.coalesce("reference_count", F.lit(0))).alias("reference_count"), F.coalesce("matches", F.lit(0)).alias("matches"), "first_match", novelty_status(ok, F.col("reference_count"), F.col("matches")).alias("novelty_status"))
    return out.withColumn("is_novel", F.when(F.col("novelty_status") != "not_evaluated_invalid", F.col("novelty_status") != "matched"))


def _ratio(elements: Column) -> Column:
    """``A1-B2`` from a list of elements: counts over their greatest common divisor."""
    kinds = F.array_sort(F.array_distinct(elements))
    counts = F.transform(kinds, lambda k: F.size(F.filter(elements, lambda e: e == k)))
    least = F.array_min(counts)
    divisor = F.array_max(F.filter(F.sequence(F.lit(1), least), lambda d: F.forall(counts, lambda n: n % d == 0)))
    text = F.zip_with(kinds, counts, lambda k, n: F.concat(k, (n / divisor).cast("int").cast("string")))
    return F.when(F.size(elements) > 0, F.array_join(text, "-"))
