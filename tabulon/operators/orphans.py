"""References to records that do not exist (problem 3).

A reference names a key and a moment; it is an orphan if no record with that key lived at that moment. Records live
from a start to an end (excluded; null end = for ever) and may have many lives under one key.

Plan: references are pre-aggregated to (key, moment) with their number, so that copies are looked up once; keys that
hold a large share of all references are few by construction and are checked against a broadcast of their lives where
that is small; the other keys go through one shuffled anti-join; both orphan sets are united. Keys with too many pairs
for either are looked up by a sorted sweep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators.skew import heavy_keys
from tabulon.session import table
from tabulon.workspace import Workspace

#: Written values that stand for "no value".
NO_VALUE = ("", "-", "None", "nan")
#: Lives of heavy keys are broadcast up to this number of rows; beyond it they are looked up by a sorted sweep.
BROADCAST_LIVES = 100_000
#: A key with more (moment, life) pairs than this is swept, not joined.
PAIRS = 4_000_000


def reference_value(column: str) -> Column:
    """A key as written, without surrounding blanks and with / read as __; words for nothing give null."""
    trimmed = F.regexp_replace(F.col(column), r"^[\s 　]+|[\s 　]+$", "")
    return F.when(trimmed.isin(*NO_VALUE), F.lit(None)).otherwise(F.replace(trimmed, F.lit("/"), F.lit("__")))


def lives_of(records: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end) of every record under each of its keys; equal lives once, of equal starts the longest."""
    each = [records.select(F.col(k).alias("key"), F.col(start).alias("start"), F.col(end).alias("end")) for k in keys]
    all_lives = reduce(DataFrame.unionByName, each).where(F.col("key").isNotNull() & F.col("start").isNotNull())
    forever = F.lit("9999-12-31").cast("timestamp_ntz")
    return all_lives.groupBy("key", "start").agg(F.max(F.coalesce(F.col("end").cast("timestamp_ntz"), forever)).alias("end"))


def _sweep(ws: Workspace, moments: DataFrame, lives: DataFrame) -> DataFrame:
    """Moments (key, at) outside every life, by one sorted pass: the latest end of the lives begun so far decides.

    Rows are range partitioned by (key, time), so a key may span any number of tasks; each range passes the latest end
    of a key on to the ranges after it.
    """
    rows = lives.select("key", F.col("start").alias("at"), F.lit(0).alias("kind"), "end").unionByName(moments.select("key", "at", F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("end")))
    staged = ws.stage(rows.repartitionByRange("key", "at", "kind").withColumn("part", F.spark_partition_id()))
    tops = staged.groupBy("part", "key").agg(F.max("end").alias("top"))
    carried = tops.withColumn("carry", F.max("top").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    within = Window.partitionBy("part", "key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = staged.join(carried, ["part", "key"]).withColumn("until", F.greatest(F.max("end").over(within), F.col("carry")))
    return known.where((F.col("kind") == 1) & ~F.coalesce(F.col("until") > F.col("at"), F.lit(False))).select("key", "at")


def orphan_references(spark: SparkSession, refs: DataFrame, lives: DataFrame, share: float = 1 / 400, broadcast_lives: int = BROADCAST_LIVES, least: int = 20_000) -> DataFrame:
    """Rows of ``refs`` (ref_table, ref_row_id, key, at, …) whose key has no life at that moment.

    A null key is an orphan; so is a null moment, as no record lives at an unknown time. Repeated rows stay repeated.
    ``lives``: (key, start, end) as of lives_of. Further columns of refs are kept.
    """
    ws = Workspace(spark, "orphans")
    lives = ws.stage(lives)
    asked = refs.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    moments = ws.stage(asked.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n")))
    one, none = F.lit(1), F.lit(0)
    both = moments.select("key", one.alias("m"), none.alias("l")).unionByName(lives.select("key", none.alias("m"), one.alias("l")))
    keys = ws.stage(both.groupBy("key").agg(F.sum("m").alias("m"), F.sum("l").alias("l"), F.count(one).alias("n")).where((F.col("n") >= least) | (F.col("m") * F.col("l") > PAIRS)))
    heavy = heavy_keys(keys, "key", "n", moments.count() + lives.count(), share, least)
    hot = F.col("key").isin(heavy) if heavy else F.lit(False)
    cold_moments, cold_lives = moments.where(~hot), lives.where(~hot)
    dense = keys.where(~hot & (F.col("m") * F.col("l") > PAIRS)).select("key")
    swept = []
    if dense.limit(1).count():
        swept.append((cold_moments.join(dense, "key", "left_semi"), cold_lives.join(dense, "key", "left_semi")))
        cold_moments, cold_lives = (x.join(dense, "key", "left_anti") for x in (cold_moments, cold_lives))
    during = lambda m, v: (m["key"] == v["key"]) & (v["start"] <= m["at"]) & (m["at"] < v["end"])
    orphans = cold_moments.join(cold_lives, during(cold_moments, cold_lives), "left_anti").select("key", "at")
    if heavy:
        hot_moments, hot_lives = moments.where(hot), lives.where(hot)
        if hot_lives.count() <= broadcast_lives:
            orphans = orphans.unionByName(hot_moments.join(F.broadcast(hot_lives), during(hot_moments, hot_lives), "left_anti").select("key", "at"))
        else:
            swept.append((hot_moments, hot_lives))
    for m, v in swept:
        orphans = orphans.unionByName(_sweep(ws, m, v))
    orphans = ws.stage(orphans)
    # A row is an orphan if its (key, moment) is; hot keys have many moments, so this join does not gather a key in one task.
    named = asked.join(orphans, ["key", "at"], "left_semi")
    return named.unionByName(refs.where(F.col("key").isNull() | F.col("at").isNull()))


def catalog_lives(spark: SparkSession, folder: str) -> DataFrame:
    return lives_of(table(spark, folder, "structure_catalog"), ["candidate_id", "legacy_id"], "cataloged_at", "deleted_at")


def candidate_references(spark: SparkSession, folder: str) -> DataFrame:
    """References of the two result tables to candidates; a row without a key refers to none, unless it claims to be mapped."""
    dft = table(spark, folder, "dft_materials").select(
        F.lit("dft_materials").alias("ref_table"), F.col("dft_row_id").alias("ref_row_id"), reference_value("candidate_id").alias("key"), F.col("parsed_at").alias("at"), (F.col("mapping_status") == "mapped").alias("claims")
    )
    topology = table(spark, folder, "topology_labels").select(
        F.lit("topology_labels").alias("ref_table"), F.col("topology_row_id").alias("ref_row_id"), reference_value("candidate_id").alias("key"), F.col("analyzed_at").alias("at"), F.lit(False).alias("claims")
    )
    return dft.unionByName(topology).where(F.col("key").isNotNull() | F.col("claims"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphan row of dft_materials and topology_labels."""
    return orphan_references(spark, candidate_references(spark, folder), catalog_lives(spark, folder)).select("ref_table", "ref_row_id")


def p3_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans by table and month; months without orphans show 0. A null moment counts under a null month."""
    refs = candidate_references(spark, folder)
    month = F.date_format("at", "yyyy-MM").alias("month")
    every = refs.groupBy("ref_table", month).agg(F.count(F.lit(1)).alias("refs"))
    orphans = orphan_references(spark, refs, catalog_lives(spark, folder)).groupBy("ref_table", month).agg(F.count(F.lit(1)).alias("orphans"))
    every, orphans = every.alias("e"), orphans.alias("o")
    same = (F.col("e.ref_table") == F.col("o.ref_table")) & F.col("e.month").eqNullSafe(F.col("o.month"))
    return every.join(orphans, same, "left").select("e.ref_table", "e.month", "e.refs", F.coalesce("o.orphans", F.lit(0)).cast("bigint").alias("orphans"))
