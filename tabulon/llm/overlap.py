"""Same or nearly the same crystals across splits (problem 2).

A crystal becomes one text of tokens: a word for each cell it can be reduced to and, in evaluation splits, for each way
its cell lengths may be written within the tolerance. A word's i-th token is made of the composition, its i-th element
(going round) and the bin of one sorted cell length; any three tokens in a row hold all three lengths. Rolling hashes over
three tokens are winnowed (the least of each window of two) and the selected ones joined across splits as seeds. Seeds of
two texts on one diagonal are chained; a chain that covers as much as a shared word must makes a candidate pair, which is
extended by aligning all sites under the tolerances. A crystal and its supercell, or a length just beyond a bin's end,
share only a part of their texts, at differing places: that is what the chains find.

No pair within the tolerances is lost before the alignment: bins are twice as wide as the tolerance, so a train length
lies in the bin of the evaluation length or in the nearer bin beside it; the texts then share a whole word, of at least
four tokens, and winnowing selects a seed from every run of that length. Cells are reduced by every divisor of the
number of formula units that the sites allow, so there is no bound on multiples.

Rows are met as classes of the same side, material and written structure; copies cost nothing until pairs of rows are
spread out, and reports count them without spreading.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.crystals import flattened, length_bins, reduced_lengths, same_crystal, units_of
from tabulon.operators.skew import heavy_keys, join_salted, join_unique
from tabulon.session import table
from tabulon.workspace import Workspace

GRAM, WINDOW = 3, 2
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def split_name(written: Column) -> Column:
    """train, validation or test for the spellings in use; null for anything else."""
    word = F.lower(F.trim(written))
    return F.when(word.isin("train", "training"), "train").when(word.isin("val", "valid", "validation", "dev"), "validation").when(word.isin("test", "testing"), "test")


def word_size(kinds: int) -> int:
    """Tokens of a word, for a composition of so many elements: enough for a seed from every shared one."""
    return max(kinds, GRAM + WINDOW - 1)


def text_of(lengths: np.ndarray, elements: list[str], coords: np.ndarray, around: bool) -> list[int]:
    """The token numbers of a crystal's words; ``around``: with those of the nearer bins beside its own."""
    import xxhash

    counts = Counter(elements)
    part = units_of(counts)
    ratio = [f"{e}{n // part}" for e, n in sorted(counts.items())]
    whole = xxhash.xxh64_intdigest("-".join(ratio))
    size = word_size(len(ratio))
    # a token's number comes from the composition, its element's place, its axis and its bin
    heads = [(whole + (i % len(ratio)) * 0x9E3779B97F4A7C15 + (i % 3) * 0xC2B2AE3D27D4EB4F) % _PRIME for i in range(size)]
    words = dict.fromkeys(b for logs in reduced_lengths(lengths, elements, coords) for b in length_bins(logs, around))
    return [(heads[i] * (2 * (bins[i % 3] + (1 << 20)) + 1)) % _PRIME for bins in words for i in range(size)]


def winnow(tokens: list[int], gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """(position, hash) of the rolling-hash minima selected from a token text; of equal minima the last."""
    hashes, value, high = [], 0, pow(_BASE, gram - 1, _PRIME)
    for i, t in enumerate(tokens):
        if i >= gram:
            value = (value - tokens[i - gram] * high) % _PRIME
        value = (value * _BASE + t) % _PRIME
        if i >= gram - 1:
            hashes.append(value)
    picked = {}
    for i in range(max(1, len(hashes) - window + 1)):
        least = min(range(i, min(i + window, len(hashes))), key=lambda j: (hashes[j], -j))
        picked[least] = hashes[least]
    return sorted(picked.items())


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for cid, trained, held, cell, elements, coords in zip(*[pdf[c] for c in ("cid", "trained", "held", "cell", "elements", "coords")]):
            lengths, elements, coords = np.array(cell[:3], float), list(elements), np.array(coords, float).reshape(-1, 3)
            size = word_size(len(set(elements)))
            for side, on in (("a", trained), ("b", held)):
                if on:
                    out.extend((cid, side, h, p, size) for p, h in winnow(text_of(lengths, elements, coords, side == "b")))
        yield pd.DataFrame(out, columns=["cid", "side", "seed", "place", "size"])


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [same_crystal(*r) for r in zip(pdf["cell_a"], pdf["elements_a"], pdf["coords_a"], pdf["cell_b"], pdf["elements_b"], pdf["coords_b"])]
        yield pdf.loc[keep, ["cid_a", "cid_b", "chain"]]


def crystal_classes(ws: Workspace, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows (row_id, side, material, structure, …): the rows of a side with their class ``cls``; the classes (cls, side,
    material, n); the crystals of each class (cls, side, cid); the distinct crystals as flat arrays.

    A row without a structure has those of its material. Equal written structures are one crystal. Structures without
    sites, or with a null length, angle, element or coordinate, or a length that isn't positive, match nothing.
    """
    flat = flattened(rows, "structure")
    flat = flat.withColumn("crystal", F.when(F.col("sound"), F.md5(F.to_json("structure")))).withColumn("lent", F.col("structure").isNull()).drop("structure", "sound")
    key = F.md5(F.to_json(F.struct("side", "material", "crystal", "lent"), {"ignoreNullFields": "false"}))
    flat = ws.stage(flat.withColumn("cls", F.when(F.col("side").isNotNull(), key)))
    classes = ws.stage(flat.where("cls IS NOT NULL").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("side", "material", "crystal", "lent")], F.count(F.lit(1)).alias("n")))
    lent = classes.where("lent AND material IS NOT NULL").select("cls", "side", "material")
    donors = flat.where("crystal IS NOT NULL AND material IS NOT NULL").join(lent.select("material").distinct(), "material", "left_semi").select("material", "crystal").distinct()
    owned = ws.stage(classes.where("crystal IS NOT NULL").select("cls", "side", "crystal").unionByName(lent.join(donors, "material").select("cls", "side", "crystal")))
    sides = owned.groupBy("crystal").agg(F.bool_or(F.col("side") == "train").alias("trained"), F.bool_or(F.col("side") == "eval").alias("held"))
    arrays = flat.where("crystal IS NOT NULL").groupBy("crystal").agg(*[F.first(c).alias(c) for c in ("cell", "elements", "coords")])
    crystals = ws.stage(arrays.join(sides, "crystal").withColumn("cid", F.monotonically_increasing_id()))
    fan = heavy_keys(owned.groupBy("crystal").agg(F.count(F.lit(1)).alias("n")), "crystal", "n", owned.count())
    owned = ws.stage(join_unique(owned, crystals.select("crystal", "cid"), "crystal", fan).select("cls", "side", "cid"))
    return flat.where("cls IS NOT NULL").drop("cell", "elements", "coords", "crystal", "lent"), classes.select("cls", "side", "material", "n"), owned, crystals


def matching_crystals(ws: Workspace, crystals: DataFrame) -> DataFrame:
    """(cid_a in train, cid_b in evaluation, chain) that are the same, by seeds, chains and alignment; ``chain``: the share of a word that the longest chain covers."""
    prints = ws.stage(crystals.select("cid", "trained", "held", "cell", "elements", "coords").mapInPandas(_fingerprints, "cid bigint, side string, seed bigint, place int, size int"))
    a = prints.where("side = 'a'").select("seed", F.col("cid").alias("cid_a"), F.col("place").alias("place_a"), "size")
    b = prints.where("side = 'b'").select("seed", F.col("cid").alias("cid_b"), F.col("place").alias("place_b"))
    per = prints.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    seeds = join_salted(a, b, "seed", heavy_keys(per, "seed", "n", prints.count()), "cid_a").where("cid_a != cid_b")
    chains = seeds.groupBy("cid_a", "cid_b", (F.col("place_b") - F.col("place_a")).alias("diagonal")).agg(F.array_sort(F.collect_set("place_a")).alias("places"), F.first("size").alias("size"))
    # tokens covered by grams at sorted places: a whole gram, or what lies beyond the gram before
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-GRAM).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(GRAM), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    chains = chains.withColumn("covered", covered).where(F.col("covered") >= F.greatest(F.lit(GRAM), F.col("size") - 2 * (WINDOW - 1)))
    candidates = ws.stage(chains.groupBy("cid_a", "cid_b").agg(F.max(F.least(F.lit(1.0), F.col("covered") / F.col("size"))).alias("chain")))
    total = candidates.count()
    whole = crystals.select("cid", "cell", "elements", "coords")
    dressed = candidates
    for s in ("a", "b"):
        fan = heavy_keys(candidates.groupBy(f"cid_{s}").agg(F.count(F.lit(1)).alias("n")), f"cid_{s}", "n", total)
        dressed = join_unique(dressed, whole.select(*[F.col(c).alias(f"{c}_{s}") for c in whole.columns]), f"cid_{s}", fan)
    # one task holds few candidates, as each alignment is costly
    different = dressed.repartition("cid_a", "cid_b").mapInPandas(_aligned, "cid_a bigint, cid_b bigint, chain double")
    equal = crystals.where("trained AND held").select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"), F.lit(1.0).alias("chain"))
    return ws.stage(different.unionByName(equal))


def class_pairs(ws: Workspace, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cls_a in train, cls_b in evaluation, chain), the rows of a side with their class, and the classes; chain is null for pairs by material alone."""
    rows = rows.withColumn("material", F.nullif(F.trim("material"), F.lit("")))
    members, classes, owned, crystals = crystal_classes(ws, rows)
    same = matching_crystals(ws, crystals)
    side = lambda df, s, *more: df.where(F.col("side") == ("train" if s == "a" else "eval")).select(F.col("cls").alias(f"cls_{s}"), *more)
    total = owned.count()
    found = same
    for s in ("a", "b"):
        fan = heavy_keys(owned.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid", "n", total)
        found = join_salted(side(owned, s, F.col("cid").alias(f"cid_{s}")), found, f"cid_{s}", fan, f"cls_{s}")
    named = classes.where("material IS NOT NULL")
    fan = heavy_keys(named.groupBy("material").agg(F.count(F.lit(1)).alias("n")), "material", "n", named.count())
    by_material = join_salted(side(named, "a", "material"), side(named, "b", "material"), "material", fan, "cls_a")
    both = found.select("cls_a", "cls_b", "chain").unionByName(by_material.select("cls_a", "cls_b", F.lit(None).cast("double").alias("chain")))
    return ws.stage(both.groupBy("cls_a", "cls_b").agg(F.max("chain").alias("chain"))), members, classes


def cross_split_pairs(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(train_row, eval_row) for rows (row_id, side, material, structure), side being train, eval or null.

    Pairs of the same material or the same crystal, each once; they are spread out from pairs of classes at the end, hot
    classes in salted parts. Rows of no side, and null or blank materials, match nothing; an empty table gives no pairs.
    """
    ws = Workspace(spark, "overlap")
    found, members, classes = class_pairs(ws, rows)
    total = members.count()
    for s, name in (("a", "train"), ("b", "eval")):
        rows_of = members.where(F.col("side") == name).select(F.col("row_id").alias(f"{name}_row"), F.col("cls").alias(f"cls_{s}"))
        found = join_salted(rows_of, found, f"cls_{s}", heavy_keys(classes, "cls", "n", total), f"{name}_row")
    return found.select("train_row", "eval_row")


def overlapping_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Every evaluation row with the number of train rows of its material or crystal and its longest chain; copies are counted, not spread out."""
    ws = Workspace(spark, "overlap")
    found, members, classes = class_pairs(ws, rows)
    fan = heavy_keys(found.groupBy("cls_a").agg(F.count(F.lit(1)).alias("n")), "cls_a", "n", found.count())
    per = join_unique(found, classes.select(F.col("cls").alias("cls_a"), "n"), "cls_a", fan).groupBy(F.col("cls_b").alias("cls")).agg(F.sum("n").alias("pairs"), F.max("chain").alias("chain"))
    return join_unique(members.where("side = 'eval'"), per, "cls", heavy_keys(classes, "cls", "n", members.count()), "left").drop("cls")


def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    split = split_name(F.col("split"))
    return table(spark, folder, "reference_snapshot").select(
        F.col("snapshot_row_id").alias("row_id"), split.alias("split"), F.when(split == "train", "train").when(split.isNotNull(), "eval").alias("side"), "database", F.col("material_id").alias("material"), "structure"
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a train row and an evaluation row of the same material or crystal, smaller id first."""
    pairs = cross_split_pairs(spark, snapshot_rows(spark, folder).where("side IS NOT NULL OR structure IS NOT NULL"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p2_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """By evaluation split and database: rows, rows with a double in train, pairs, the share of rows covered, and the mean
    share of a word that the chains of the rows found by their crystal cover."""
    rows = overlapping_rows(spark, snapshot_rows(spark, folder))
    by = rows.groupBy("split", "database").agg(F.count(F.lit(1)).alias("rows"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("chain"), 6).alias("chain_coverage"))
    return by.withColumn("coverage", F.round(F.col("overlapping") / F.col("rows"), 6))
