"""Entity resolution and best-row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.semantics import is_finite, last_wins


def unique_only(records: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, matches): the value only where exactly one distinct value has the key, else null. Null keys are left out."""
    by = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count_distinct(value).alias("matches"))
    return by.select(key, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).alias(value), "matches")


def unique_only_join(left: DataFrame, records: DataFrame, left_key: str, key: str, value: str) -> DataFrame:
    """left with ``value``, taken only from an unambiguous match, and ``match_note``: matched, ambiguous or missing."""
    keyed = unique_only(records, key, value).withColumnRenamed(key, "__key").withColumnRenamed(value, "__value")
    joined = left.join(keyed, left[left_key] == keyed["__key"], "left")
    note = F.when(F.col("matches").isNull(), "missing").when(F.col("matches") == 1, "matched").otherwise("ambiguous")
    return joined.withColumn(value, F.col("__value")).withColumn("match_note", note).drop("__key", "__value", "matches")


def resolution_cascade(left: DataFrame, by_key: DataFrame, by_block: DataFrame, key: Column, block: list[str]) -> DataFrame:
    """Resolves rows in stages: a unique key is accepted as it is; else records of the same block decide.

    by_key: (key, record); by_block: (block columns, record). One record in the block: mapped; several: mapped if the
    key names one of them directly, else ambiguous; none: unmapped. Adds mapping_status, mapping_method, record.
    """
    keys = unique_only(by_key, "key", "record").select(F.col("key").alias("__key"), F.col("record").alias("__direct"), F.col("matches").alias("__direct_n"))
    blocks = by_block.groupBy(*block).agg(F.count_distinct("record").alias("__block_n"), F.min("record").alias("__block_one"))
    rows = left.withColumn("__k", key).join(keys, F.col("__k") == F.col("__key"), "left").join(blocks, block, "left")
    n = F.coalesce("__block_n", F.lit(0))
    unique_key = F.coalesce(F.col("__direct_n") == 1, F.lit(False))
    status = F.when(unique_key | (n == 1), "mapped").when(n > 1, "ambiguous").otherwise("unmapped")
    method = F.when(unique_key, "unique_key").when(n == 1, "block_match").when(n > 1, F.concat(n.cast("string"), F.lit("_block_matches"))).otherwise("no_match")
    record = F.when(unique_key, F.col("__direct")).when(n == 1, F.col("__block_one"))
    return rows.withColumn("mapping_status", status).withColumn("mapping_method", method).withColumn("record", record).drop("__k", "__key", "__direct", "__direct_n", "__block_n", "__block_one")


def primary_per_group(df: DataFrame, group: list[str], complete: Column, order: list[str]) -> DataFrame:
    """One row a group: among complete rows (else all) the greatest in ``order``. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in group]
    rank = F.struct(F.coalesce(complete, F.lit(False)).alias("c"), *order)
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*group, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def best_row_per_key(df: DataFrame, key: list[str], first: list[Column]) -> DataFrame:
    """One row a key: the least by the sort values ``first`` (numbers; null sorts last, as infinity)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first)])).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def relative_to_group_min(df: DataFrame, group: str, value: Column, name: str, low: float = 0.1) -> DataFrame:
    """Adds ``name`` = value minus the least finite value of its group, and ``name_low`` (at most ``low``); null where not finite.

    The minima are a grouped aggregate joined back, so a large group is combined before the shuffle.
    """
    finite = F.when(is_finite(value), value)
    minima = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.min(finite).alias("__min"))
    joined = df.join(minima, df[group] == minima["__g"], "left")
    return joined.withColumn(name, finite - F.col("__min")).withColumn(f"{name}_low", F.col(name) <= low).drop("__g", "__min")


def merge_shards(shards: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of shards (columns by name, missing ones null); of equal keys the one of the last shard."""
    numbered = [s.withColumn("__shard", F.lit(i)) for i, s in enumerate(shards)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    return last_wins(whole, key, "__shard").drop("__shard")


def upgrade_merge(df: DataFrame, key: str, order: str, has_more: Column) -> DataFrame:
    """Of equal keys the first row in order, replaced by the first that has more; ``place`` is the key's first order."""
    by = Window.partitionBy(key)
    n = F.row_number().over(by.orderBy(F.coalesce(has_more, F.lit(False)).desc(), order))
    return df.withColumn("place", F.min(order).over(by)).withColumn("__n", n).where("__n = 1").drop("__n")


def exclusion_reasons(df: DataFrame, reasons: dict[str, list[tuple[Column, str]]]) -> DataFrame:
    """For each dimension the first reason that applies, and whether there is one; rows without any reason are left out."""
    any_reason = F.lit(False)
    for dimension, cases in reasons.items():
        reason = F.lit(None).cast("string")
        for condition, text in reversed(cases):
            reason = F.when(F.coalesce(condition, F.lit(False)), text).otherwise(reason)
        df = df.withColumn(f"{dimension}_reason", reason).withColumn(f"excluded_from_{dimension}", reason.isNotNull())
        any_reason = any_reason | F.col(f"excluded_from_{dimension}")
    return df.where(any_reason)


def not_done(tasks: DataFrame, done: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Tasks not finished yet; with ``failed``, failed ones count as not finished."""
    finished = done.where(~F.coalesce(failed, F.lit(False))) if failed is not None else done
    return tasks.join(finished.select(key).distinct(), key, "left_anti")


def ordered_slice(df: DataFrame, order: list[Column], offset: int, limit: int, skip: list[int], position: str = "position") -> DataFrame:
    """Rows offset .. offset + limit of a stable order with their position; positions in ``skip`` stay, marked as skipped."""
    part = df.orderBy(*order).offset(offset).limit(limit)
    n = F.row_number().over(Window.orderBy(*order)) - 1 + offset  # over at most ``limit`` rows
    return part.withColumn(position, n).withColumn("skipped", F.col(position).isin(skip) if skip else F.lit(False))
