"""Small relational operators on records: projections, ordered sets, blocks and nearest values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_constants(df: DataFrame, constants: Mapping[str, str]) -> DataFrame:
    """df with a text column of one value for each entry."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def renamed_subset(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The given columns, in order, under new names; other columns are dropped."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def notes(parts: Mapping[str, Column], unknown: str = "unknown") -> Column:
    """``key=value`` texts joined by ``; ``; null and blank values read ``unknown``."""
    shown = lambda v: F.coalesce(F.nullif(F.trim(v.cast("string")), F.lit("")), F.lit(unknown))
    return F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), shown(v)) for k, v in parts.items()])


def per_unit(values: list[Column], units: Column) -> Column:
    """The first value that is finite over the number of units; null without a value or units."""
    known = F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in values])
    return known / F.nullif(units.cast("double"), F.lit(0.0))


def validity(strict: bool) -> Column:
    """The flag that records must have: strict stoichiometry, or only the condition. Null fails."""
    return F.coalesce(F.col("stoichiometry_valid" if strict else "condition_valid"), F.lit(False))


def without_parts(name: Column, suffixes: list[str] = (), parts: list[str] = ()) -> Column:
    """Whether a name ends with none of the suffixes and holds none of the parts; null names do not."""
    bad = F.lit(False)
    for s in suffixes:
        bad = bad | name.endswith(s)
    for p in parts:
        bad = bad | name.contains(p)
    return F.coalesce(~bad, F.lit(False))


def shortfall(df: DataFrame, budget: int) -> DataFrame:
    """One row: rows selected, the budget and what is missing to it."""
    return df.agg(F.count(F.lit(1)).alias("selected")).select("selected", F.lit(budget).cast("bigint").alias("budget"), F.greatest(F.lit(budget) - F.col("selected"), F.lit(0)).cast("bigint").alias("shortfall"))


def batch_scores(df: DataFrame, batch: str, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """One row: precision, recall and accuracy of score >= cut, each the mean over the batches where it is defined."""
    known = df.where(F.col(batch).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    high, true = F.col(score) >= cut, F.col(label) == 1
    per = known.groupBy(batch).agg(F.count_if(high & true).alias("tp"), F.count_if(high).alias("p"), F.count_if(true).alias("t"), F.count_if(high == true).alias("same"), F.count(F.lit(1)).alias("n"))
    mean = lambda a, b: F.round(F.avg(F.try_divide(F.col(a).cast("double"), F.col(b))), 6)
    return per.agg(F.count(F.lit(1)).alias("batches"), mean("tp", "p").alias("precision"), mean("tp", "t").alias("recall"), mean("same", "n").alias("accuracy"))


def answered(cases: DataFrame, answers: DataFrame, key: str, answer: str) -> DataFrame:
    """cases with their answer, the empty text where there is none; ``answers`` has one row a key."""
    return cases.join(answers.select(key, answer), key, "left").withColumn(answer, F.coalesce(answer, F.lit("")))


def first_seen_list(df: DataFrame, key: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """By key the distinct values in order of their first occurrence; null values are left out."""
    first = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(F.struct(*order)).alias("__o"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda s: s[value]).alias(name))


def common_values(df: DataFrame, key: str, part: Column, parts: list, value: str, name: str) -> DataFrame:
    """By key the sorted values that occur in every one of the parts; keys that lack a part have none."""
    seen = df.where(F.col(value).isNotNull() & part.isin(parts)).groupBy(key, value).agg(F.count_distinct(part).alias("__n"))
    whole = seen.where(F.col("__n") == len(parts)).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return df.select(key).distinct().join(whole, key, "left").withColumn(name, F.coalesce(name, F.array().cast(whole.schema[name].dataType)))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and repeats; null if either is null."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def counter_edges(edges: DataFrame, graph: str, order: list[str], source: str, target: str) -> DataFrame:
    """(graph, place, i, j): each graph's edges in order, then as many reversed ones in the same order, numbered from 0."""
    w = Window.partitionBy(graph)
    numbered = edges.select(graph, F.col(source).alias("i"), F.col(target).alias("j"), (F.row_number().over(w.orderBy(*order)) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    both = F.explode(F.array(F.struct(F.col("k").cast("bigint").alias("place"), F.col("i"), F.col("j")), F.struct((F.col("k") + F.col("n")).alias("place"), F.col("j").alias("i"), F.col("i").alias("j"))))
    return numbered.select(graph, both.alias("e")).select(graph, "e.*")


def nearest_value(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """left (with distinct rows) and the right ``value`` whose ``at`` is nearest within ``by``, of equals the lower one; null if there is none.

    Both sides are sorted once by (by, at); each row takes the nearer of the right values last before and first after it.
    Of right rows with the same ``at`` the least value stands. Rows without ``at`` get null.
    """
    r = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.min(value).alias("__v")).withColumn("__side", F.lit(0))
    both = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    met = F.when(F.col("__side") == 0, F.struct(F.col(at).alias("a"), F.col("__v").alias("v")))
    order = Window.partitionBy(*by).orderBy(F.col(at), F.col("__side"))
    back = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col("__side"))
    done = both.withColumns({"__b": F.last(met, ignorenulls=True).over(order), "__f": F.last(met, ignorenulls=True).over(back)}).where("__side = 1")
    down, up = F.col(at) - F.col("__b.a"), F.col("__f.a") - F.col(at)
    pick = F.when(F.col(at).isNull(), None).when(up.isNull() | (down <= up), F.col("__b.v")).otherwise(F.col("__f.v"))
    return done.select(*left.columns, F.coalesce(pick, F.when(F.col(at).isNotNull(), F.col("__f.v"))).alias(name))


def longest_first(words: list[str]) -> str:
    """A regular expression of the words that takes the longest one at a place, not inside longer words."""
    import re

    return r"\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"


def sorted_json(entries: Column) -> Column:
    """A JSON text of a map with text keys, its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def block_replaced(text: Column, pattern: str, put: Column | str) -> Column:
    """text with the first match of the pattern (which may span lines) replaced wherever that very block occurs."""
    block = F.regexp_extract(text, pattern, 0)
    put = F.lit(put) if isinstance(put, str) else put
    return F.when(block == "", text).otherwise(F.replace(text, block, put))


def stamped(name: Column, at: Column) -> Column:
    """name_YYYYMMDD_HHMMSS"""
    return F.concat_ws("_", name, F.date_format(at, "yyyyMMdd_HHmmss"))
