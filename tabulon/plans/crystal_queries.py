"""Groups of equal crystals and novelty by structure, on reference structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import crystals
from tabulon.session import table


def content_keys(spark, d):
    """Structures by whether another row has the very same content."""
    r = table(spark, d, "reference_snapshot").where("structure IS NOT NULL").select("snapshot_row_id", crystals.content_key(F.col("structure")).alias("content"))
    n = r.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy((F.col("n") > 1).alias("repeated")).agg(F.sum("n").alias("rows"))


def structure_leaders(spark, d):
    """Every reference structure with the first one of its space group that it matches."""
    return crystals.structure_leaders(table(spark, d, "reference_snapshot"), "snapshot_row_id", "structure", within="spacegroup_number")


def structure_novelty(spark, d):
    """Structures of the test split against those of the train split."""
    r = table(spark, d, "reference_snapshot")
    word = F.lower(F.trim("split"))
    return crystals.structure_novelty(r.where(word.isin("test", "testing")), r.where(word.isin("train", "training")), "snapshot_row_id", "material_id", "structure", F.lit(True))


QUERIES = {f.__name__: f for f in (content_keys, structure_leaders, structure_novelty)}
ORACLE = {
    "content_keys": """
WITH x AS (SELECT structure.lattice AS l, list_sort(list_transform(structure.sites, lambda s: {'e': s.element, 'x': list_transform(s.frac_coords, lambda v: round(v - floor(v), 6))})) AS s FROM reference_snapshot WHERE structure IS NOT NULL),
n AS (SELECT round(l.a, 6), round(l.b, 6), round(l.c, 6), round(l.alpha, 6), round(l.beta, 6), round(l.gamma, 6), s, count(*) AS n FROM x GROUP BY ALL)
SELECT n > 1 AS repeated, sum(n)::BIGINT AS rows FROM n GROUP BY 1""",
}
