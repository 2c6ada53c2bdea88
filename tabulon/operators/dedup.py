"""Exact and near duplicates within blocks, and novelty against references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*parts: Column, length: int = 12) -> Column:
    """First digits of the SHA-256 of the parts as JSON (nulls kept)."""
    return F.left(F.sha2(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256), F.lit(length))


def exact_duplicates(df: DataFrame, block: list[str], content: Column, id_: str, eligible: Column) -> DataFrame:
    """(id, duplicate_of, is_unique): of equal content in a block the least id is the one; ineligible rows have nulls.

    A grouped minimum joined back on block and content, so copies are combined before the shuffle.
    """
    rows = df.select(F.col(id_), *block, content.alias("__c"), F.coalesce(eligible, F.lit(False)).alias("__e"))
    heads = rows.where("__e").groupBy(*block, "__c").agg(F.min(id_).alias("__first"))
    ok = rows["__c"].eqNullSafe(heads["__c"]) & rows["__e"]
    for b in block:
        ok = ok & rows[b].eqNullSafe(heads[b])
    joined = rows.join(heads, ok, "left").select(rows[id_], rows["__e"], "__first")
    dup = F.col("__first") != F.col(id_)
    return joined.select(id_, F.when(dup, F.col("__first")).alias("duplicate_of"), F.when(F.col("__e"), ~F.coalesce(dup, F.lit(False))).alias("is_unique"))


def leader_clusters(df: DataFrame, block: str, id_: str, vector: str, similarity: float) -> DataFrame:
    """(id, leader): in order of id, each row joins the first leader of its block at least so similar, else becomes one.

    The rule is sequential within a block, so a block is one task; the compared vectors are those of its leaders. Large
    blocks should first lose exact duplicates. Null vectors and rows of no block lead themselves.
    """
    kind = df.schema[id_].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        leaders: list = []
        ids: list = []
        out = []
        for i, v in zip(pdf[id_], pdf[vector]):
            v = np.asarray(v, float)
            n = np.linalg.norm(v)
            v = v / n if n else v
            near = np.flatnonzero(np.vstack(leaders) @ v >= similarity) if leaders else []
            if len(near):
                out.append(ids[near[0]])
            else:
                leaders.append(v)
                ids.append(i)
                out.append(i)
        return pd.DataFrame({id_: pdf[id_], "leader": out})

    whole = F.col(block).isNotNull() & F.col(vector).isNotNull()
    grouped = df.where(whole).select(block, id_, vector).groupBy(block).applyInPandas(run, f"{id_} {kind}, leader {kind}")
    return grouped.unionByName(df.where(~whole).select(id_, F.col(id_).alias("leader")))


def novelty_status(valid: Column, references: Column, matches: Column) -> Column:
    """No references: composition_novel; some, none the same: structure_novel; else matched; invalid candidates aren't evaluated."""
    return F.when(~F.coalesce(valid, F.lit(False)), "not_evaluated_invalid").when(F.coalesce(references, F.lit(0)) == 0, "composition_novel").when(F.coalesce(matches, F.lit(0)) == 0, "structure_novel").otherwise("matched")


def novelty(candidates: DataFrame, references: DataFrame, block: str, keys: list[tuple[str, str]], id_: str, ref_id: str, valid: Column) -> DataFrame:
    """Per candidate: references of its block, matched ids, status (novelty_status) and whether it is new.

    A reference is the same if the candidate's and its own column of each of ``keys`` agree. References are gathered by
    block and keys first, so each candidate meets one row, however many references a block has.
    """
    mine = [k for k, _ in keys]
    counts = references.groupBy(block).agg(F.count(F.lit(1)).alias("__refs"))
    gathered = references.groupBy(block, *[F.col(r).alias(c) for c, r in keys]).agg(F.array_sort(F.collect_set(ref_id)).alias("__ids"))
    c = candidates.withColumn("__valid", F.coalesce(valid, F.lit(False))).select(id_, block, *mine, "__valid")
    done = c.join(counts, block, "left").join(gathered, [block, *mine], "left")
    ids = F.when(F.col("__valid"), F.col("__ids"))
    status = novelty_status(F.col("__valid"), F.col("__refs"), F.size(ids))
    out = done.select(id_, F.coalesce("__refs", F.lit(0)).cast("bigint").alias("reference_count"), F.coalesce(F.array_join(ids, ";"), F.lit("")).alias("matched_ids"), status.alias("novelty_status"))
    return out.withColumn("is_novel", F.when(F.col("novelty_status") != "not_evaluated_invalid", F.col("novelty_status") != "matched"))
