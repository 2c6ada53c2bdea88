"""Keyed lookups of nested reference entries, path matching and graded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import canonical_path, either_way, name_score, plain_name
from tabulon.operators.skew import heavy_keys, join_salted
from tabulon.workspace import Workspace


def merged_entries(entries: DataFrame, key: list[str], name: str) -> DataFrame:
    """One row a key and name: essential before accidental (``category_ord``, ``ord``), replaced by one that has paths.

    entries: key, category_ord, ord, name, paths (array). The place is that of the first occurrence.
    """
    by = Window.partitionBy(*key, name)
    first = F.struct("category_ord", "ord")
    n = F.row_number().over(by.orderBy((F.size("paths") > 0).desc(), "category_ord", "ord"))
    return entries.withColumn("first_place", F.min(first).over(by)).withColumn("__n", n).where("__n = 1").drop("__n")


def lookup(keys: DataFrame, entries: DataFrame, key: list[str], name: str) -> DataFrame:
    """Per key the ordered list of merged entry names (empty if unknown)."""
    listed = merged_entries(entries, key, name).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_place", name))), lambda s: s[name]).alias("entries"))
    return keys.join(listed, key, "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<string>")))


def match_paths(observed: DataFrame, known: DataFrame, block: list[str], path: str, known_path: str, entry: str) -> DataFrame:
    """observed with the sorted known entries on the same path in either direction, and whether that is unique.

    An equality join on the smaller of path and reversed path, within the block; distinct paths are matched once and joined
    back by value. Rows without a block or path match nothing.
    """
    o = observed.withColumn("__p", either_way(canonical_path(F.col(path))))
    k = known.withColumn("__p", either_way(canonical_path(F.col(known_path)))).select(*block, "__p", entry).where("__p != ''").distinct()
    hits = o.select(*block, "__p").distinct().join(k, [*block, "__p"]).groupBy(*block, "__p").agg(F.array_sort(F.collect_set(entry)).alias("candidates"))
    done = o.join(hits, [*block, "__p"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    status = F.when(F.size("candidates") == 1, "unique").when(F.size("candidates") > 1, "ambiguous").otherwise("not_indexed")
    return done.withColumn("path_status", status).select(*observed.columns, "candidates", "path_status")


def named_like(ws: Workspace, names: DataFrame, name: str, queries: DataFrame, query_id: str, query: str, gram: int = 4) -> DataFrame:
    """(query id, query, name, score) of every name that equals, starts with or contains the query, by plain letters and digits.

    A name that contains a query contains each of its grams, so each query meets only the names that have its rarest one
    (of ``gram`` characters, or the whole query if that is shorter); the names are then scored. Blank queries match nothing.
    """
    cut = lambda p, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substr(p, i, n)))
    asked = ws.stage(queries.select(query_id, query).withColumn("__p", plain_name(F.col(query))).where("__p != ''"))
    size = F.least(F.length("__p"), F.lit(gram))
    wanted = ws.stage(asked.select(query_id, F.explode(cut(F.col("__p"), size)).alias("__g")))
    known = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("__n", plain_name(F.col(name)))
    lengths = [r[0] for r in asked.select(size.alias("s")).distinct().collect()]  # at most ``gram`` values
    if not lengths:
        return asked.select(query_id, query, F.lit(None).cast("string").alias(name), F.lit(None).cast("int").alias("score"))
    each = known.select(name, "__n", F.explode(F.array_distinct(F.flatten(F.array(*[cut(F.col("__n"), F.lit(n)) for n in lengths])))).alias("__g"))
    held = ws.stage(each.join(wanted.select("__g").distinct(), "__g", "left_semi"))
    counts = ws.stage(held.groupBy("__g").agg(F.count(F.lit(1)).alias("__c")))
    rarest = wanted.join(counts, "__g", "left").groupBy(query_id).agg(F.min_by("__g", F.struct(F.coalesce("__c", F.lit(0)).alias("c"), F.col("__g"))).alias("__g"))
    met = join_salted(held, rarest.join(asked, query_id), "__g", heavy_keys(counts, "__g", "__c", held.count()), name)
    return met.select(query_id, query, name, name_score(F.col(name), F.col(query)).alias("score")).where("score IS NOT NULL")


def best_named(scored: DataFrame, query_id: str, query: str, name: str) -> DataFrame:
    """(query id, query, score, ties, name): each query's best score, how many names have it, and the least of them."""
    per = scored.groupBy(query_id, query, "score").agg(F.count(F.lit(1)).alias("ties"), F.min(name).alias(name))
    return per.groupBy(query_id, query).agg(F.max_by(F.struct("score", "ties", name), "score").alias("b")).select(query_id, query, "b.*")


def only_best(best: DataFrame, query: str, name: str) -> DataFrame:
    """best_named with the names; a query with several equally good names is an error that says so."""
    told = F.concat(F.lit("several results fit "), F.col(query), F.lit(": "), F.col("ties").cast("string"))
    return best.withColumn(name, F.when(F.col("ties") > 1, F.raise_error(told)).otherwise(F.col(name)))


def compared(summaries: DataFrame, entries: DataFrame, block: list[str], path: str, abbreviation: str) -> DataFrame:
    """One row a summarised path and known entry on it (in either direction): path, crossings, abbreviation, line, page and
    classification by the number of entries; paths without an entry keep one row with nulls.

    summaries: block, path, crossings; entries: block, path, abbreviation, line_label, page.
    """
    s = summaries.withColumn("__p", either_way(canonical_path(F.col(path))))
    e = entries.withColumn("__p", either_way(canonical_path(F.col(path)))).where("__p != ''").select(*block, "__p", abbreviation, "line_label", "page").distinct()
    kinds = e.groupBy(*block, "__p").agg(F.count_distinct(abbreviation).alias("__k"))
    met = s.join(kinds, [*block, "__p"], "left").join(e, [*block, "__p"], "left")
    status = F.when(F.coalesce("__k", F.lit(0)) == 0, "not_indexed").when(F.col("__k") == 1, "unique").otherwise("ambiguous")
    return met.select(*summaries.columns, abbreviation, "line_label", "page", status.alias("classification"))


def gap_class(gap: Column, tolerance: float) -> Column:
    r = gap / tolerance
    return F.when(r <= 0.25, "well_below_threshold").when(r <= 0.75, "below_threshold").otherwise("near_threshold")


def energy_class(energy: Column) -> Column:
    e = F.abs(energy)
    return F.when(e <= 0.1, "within_0.1_eV_of_fermi").when(e <= 0.5, "within_0.5_eV_of_fermi").otherwise("far_from_fermi")


def evidence_level(n: Column, unique: Column) -> Column:
    """L0 without hits, L3 with a unique one, else L2."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "L0").when(F.coalesce(unique, F.lit(0)) > 0, "L3").otherwise("L2")


def limitations(cases: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in cases]), lambda x: x.isNotNull())
