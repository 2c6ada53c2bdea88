"""Entity resolution, best rows, merges, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import resolve, select
from tabulon.operators.orphans import reference_value
from tabulon.session import table


def unique_only_join(spark, d):
    topology = table(spark, d, "topology_labels").select("topology_row_id", "result_name")
    return resolve.unique_only_join(topology, table(spark, d, "structure_catalog"), "result_name", "legacy_id", "candidate_id")


def resolution_cascade(spark, d):
    cat = table(spark, d, "structure_catalog")
    dft = table(spark, d, "dft_materials").select("dft_row_id", "result_name", "reduced_formula", "atom_count", "target_spacegroup")
    by_key = cat.select(F.col("legacy_id").alias("key"), F.col("candidate_id").alias("record"))
    block = ["reduced_formula", "atom_count", "target_spacegroup"]
    done = resolve.resolution_cascade(dft, by_key, cat.select(*block, F.col("candidate_id").alias("record")), F.col("result_name"), block)
    return done.select("dft_row_id", "mapping_status", "mapping_method", "record")


def primary_per_result(spark, d):
    t = table(spark, d, "topology_labels").where("result_name IS NOT NULL")
    best = resolve.primary_per_group(t.select("result_name", "topology_row_id", "analysis_completed", "band_job_directory", "crossing_count"), ["result_name"], F.col("analysis_completed"), ["band_job_directory", "topology_row_id"])
    return best.select("result_name", "topology_row_id", "band_job_directory", "crossing_count")


def best_labelled_row(spark, d):
    """Per candidate the result with topology first, then least energy (missing: infinite), then name, then id."""
    dft = table(spark, d, "dft_materials").where("candidate_id IS NOT NULL").select("candidate_id", "result_name", "dft_row_id", "relax_energy_per_atom_ev")
    done = table(spark, d, "topology_labels").where("analysis_completed").select("result_name").distinct().withColumn("has_topology", F.lit(True))
    joined = dft.join(done, "result_name", "left")
    energy = F.when(F.isnan("relax_energy_per_atom_ev"), None).otherwise(F.col("relax_energy_per_atom_ev"))
    order = [F.when(F.col("has_topology"), 0).otherwise(1), F.coalesce(energy, F.lit(float("inf"))), F.col("result_name"), F.col("dft_row_id")]
    best = resolve.best_row_per_key(joined, ["candidate_id"], order)
    return best.select("candidate_id", "dft_row_id", F.coalesce("has_topology", F.lit(False)).alias("has_topology"))


def relative_energy(spark, d):
    """Static energy if that run is complete, else the converged relaxation's; relative to the formula's least."""
    dft = table(spark, d, "dft_materials")
    measure = F.coalesce(F.when(F.col("static_soc_completed"), F.col("static_soc_energy_per_atom_ev")), F.when(F.col("relax_converged"), F.col("relax_energy_per_atom_ev")))
    done = resolve.relative_to_group_min(dft, "reduced_formula", measure, "relative")
    return done.select("dft_row_id", F.round("relative", 6).alias("relative"), F.col("relative_low").alias("low_energy"))


def exclusion_reasons(spark, d):
    dft = table(spark, d, "dft_materials").select("dft_row_id", "mapping_status", "relax_converged", "band_soc_completed", "irvsp_completed", "band_symmetry_consistent")
    unmapped = F.coalesce(F.col("mapping_status") != "mapped", F.lit(True))
    return resolve.exclusion_reasons(
        dft,
        {
            "stability": [(unmapped, "not mapped"), (~F.coalesce("relax_converged", F.lit(False)), "relaxation not converged")],
            "topology": [(unmapped, "not mapped"), (~F.coalesce("band_soc_completed", F.lit(False)), "no band structure"), (~F.coalesce("irvsp_completed", F.lit(False)), "no irreps"), (~F.col("band_symmetry_consistent"), "symmetry not consistent")],
        },
    ).select("dft_row_id", "stability_reason", "excluded_from_stability", "topology_reason", "excluded_from_topology")


def shard_merge_last_wins(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = o.where("o_orderkey % 3 != 0")
    second = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") + 1, 2))
    return resolve.merge_shards([first, second], ["o_orderkey"])


def upgrade_merge(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    done = resolve.upgrade_merge(p, "p_brand", "p_partkey", F.col("p_size") >= 25)
    return done.select("p_brand", "p_partkey", "place", "p_size")


def resume_tasks(spark, d):
    """Results whose topology analysis isn't done: never tried, or failed only."""
    dft = table(spark, d, "dft_materials").where("result_name IS NOT NULL").select("result_name").distinct()
    return resolve.not_done(dft, table(spark, d, "topology_labels"), "result_name", ~F.coalesce("analysis_completed", F.lit(False)))


def relevant_references(spark, d):
    """Reference rows of formulas that some valid candidate has (semi-join)."""
    wanted = table(spark, d, "structure_catalog").where("valid_structure").select("reduced_formula").distinct()
    return table(spark, d, "reference_snapshot").join(wanted, "reduced_formula", "left_semi").select("snapshot_row_id", "material_id", "reduced_formula")


def offset_limit_skip(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return resolve.ordered_slice(p, [F.col("p_retailprice").desc(), F.col("p_partkey")], 40, 120, [45, 60, 61])


def first_seen_groups(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.min_by("event_type", "event_id").alias("first_type"))


def _scored(spark, d):
    """Catalogue rows with predictions: per candidate the mean out-of-fold probability, with its spread as uncertainty."""
    p = table(spark, d, "particle_dp_oof_predictions").withColumn("key", reference_value("candidate_id")).where("key IS NOT NULL AND oof_probability IS NOT NULL AND NOT isnan(oof_probability)")
    p = p.groupBy("key").agg(F.round(F.avg("oof_probability"), 6).alias("topology_probability"), F.round(F.max("oof_probability") - F.min("oof_probability"), 6).alias("uncertainty"))
    cat = table(spark, d, "structure_catalog").select("catalog_row_id", "candidate_id", "reduced_formula", "actual_spacegroup", "stoichiometry_valid", "condition_valid", "target_spacegroup_match", "is_unique")
    return cat.withColumn("key", reference_value("candidate_id")).join(p, "key", "left").drop("key")


def funnel_topk(spark, d):
    """Strict funnel: valid, symmetry kept and unique; missing predictions count as neutral."""
    strict = F.coalesce("stoichiometry_valid", F.lit(False)) & F.coalesce("target_spacegroup_match", F.lit(False)) & F.coalesce("is_unique", F.lit(False))
    score = F.round(select.multiobjective_score(F.lit(None).cast("double"), F.col("topology_probability"), F.col("uncertainty"), F.lit(0.0)), 6)
    scored = _scored(spark, d).where(strict).withColumn("score", score)
    return select.top_ranked(scored.select("catalog_row_id", "candidate_id", "score"), [F.col("score").desc(), F.col("candidate_id"), F.col("catalog_row_id")], 500)


def _prefunnel(spark, d):
    loose = F.coalesce("condition_valid", F.lit(False)) & F.coalesce("is_unique", F.lit(False)) & F.col("topology_probability").isNotNull()
    rows = _scored(spark, d).where(loose).withColumn("tier", F.when(F.coalesce("stoichiometry_valid", F.lit(False)), "A").otherwise("B"))
    rows = rows.withColumn("score", F.round(select.multiobjective_score(F.lit(None).cast("double"), F.col("topology_probability"), F.col("uncertainty"), F.lit(0.0)), 6))
    rows = rows.select("catalog_row_id", "candidate_id", "reduced_formula", "actual_spacegroup", "tier", "score")
    return select.capped_fill(rows, ["reduced_formula", "actual_spacegroup"], [F.col("tier"), F.col("score").desc(), F.col("candidate_id"), F.col("catalog_row_id")], 3, 500)


def prefunnel_capped_fill(spark, d):
    """Tiered selection with at most 3 a formula and space group, then filled without the cap."""
    return _prefunnel(spark, d).select("catalog_row_id", "tier", "score", "cap_relaxed", "rank")


def balanced_assignment(spark, d):
    """Each selected row takes the least used of its formula's particles among the confirmed ones."""
    t = table(spark, d, "topology_labels").where("compatible_particles IS NOT NULL")
    names = t.select("spacegroup_number", F.explode(F.split("compatible_particles", ";")).alias("p")).where("trim(p) != ''")
    options = names.groupBy(F.col("spacegroup_number").alias("actual_spacegroup")).agg(F.array_sort(F.collect_set(F.trim("p"))).alias("options"))
    chosen = _prefunnel(spark, d).join(options, "actual_spacegroup", "left")
    return select.balanced_assignment(chosen, "rank", "options", "particle").select("rank", "catalog_row_id", "particle")


def matched_targets(spark, d):
    return select.matched_targets(table(spark, d, "structure_catalog").where("condition_valid"), ["reduced_formula", "target_spacegroup"], 5)


QUERIES = {
    f.__name__: f
    for f in (unique_only_join, resolution_cascade, primary_per_result, best_labelled_row, relative_energy, exclusion_reasons, shard_merge_last_wins, upgrade_merge, resume_tasks, relevant_references, offset_limit_skip, first_seen_groups, funnel_topk, prefunnel_capped_fill, balanced_assignment, matched_targets)
}

_SCORED = """
WITH v AS (SELECT *, regexp_replace(candidate_id, '^[\\s\u00a0\u3000]+|[\\s\u00a0\u3000]+$', '', 'g') AS t FROM particle_dp_oof_predictions),
k AS (SELECT *, CASE WHEN t NOT IN ('', '-', 'None', 'nan') THEN replace(t, '/', '__') END AS key FROM v),
p AS (SELECT key, round(avg(oof_probability), 6) AS tp, round(max(oof_probability) - min(oof_probability), 6) AS u
  FROM k WHERE key IS NOT NULL AND oof_probability IS NOT NULL AND NOT isnan(oof_probability) GROUP BY 1),
s AS (SELECT c.*, p.tp, round(sqrt(greatest(0.5, 1e-9) * greatest(coalesce(tp, 0.5), 1e-9)) + 0.05 * greatest(coalesce(u, 0), 0), 6) AS score
  FROM structure_catalog c LEFT JOIN p ON p.key = c.candidate_id)
"""

ORACLE = {
    "unique_only_join": """
WITH u AS (SELECT legacy_id, count(DISTINCT candidate_id) AS n, min(candidate_id) AS c FROM structure_catalog WHERE legacy_id IS NOT NULL GROUP BY 1)
SELECT topology_row_id, result_name, CASE WHEN n = 1 THEN c END AS candidate_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS match_note
FROM topology_labels t LEFT JOIN u ON t.result_name = u.legacy_id""",
    "resolution_cascade": """
WITH u AS (SELECT legacy_id, count(DISTINCT candidate_id) AS n, min(candidate_id) AS c FROM structure_catalog GROUP BY 1),
b AS (SELECT reduced_formula, atom_count, target_spacegroup, count(DISTINCT candidate_id) AS m, min(candidate_id) AS one FROM structure_catalog GROUP BY 1, 2, 3),
j AS (SELECT dft_row_id, coalesce(n = 1, false) AS k, c, coalesce(m, 0) AS m, one FROM dft_materials d LEFT JOIN u ON d.result_name = u.legacy_id
  LEFT JOIN b ON d.reduced_formula = b.reduced_formula AND d.atom_count = b.atom_count AND d.target_spacegroup = b.target_spacegroup)
SELECT dft_row_id, CASE WHEN k OR m = 1 THEN 'mapped' WHEN m > 1 THEN 'ambiguous' ELSE 'unmapped' END AS mapping_status,
  CASE WHEN k THEN 'unique_key' WHEN m = 1 THEN 'block_match' WHEN m > 1 THEN m || '_block_matches' ELSE 'no_match' END AS mapping_method,
  CASE WHEN k THEN c WHEN m = 1 THEN one END AS record FROM j""",
    "primary_per_result": """
SELECT result_name, topology_row_id, band_job_directory, crossing_count FROM (SELECT *, row_number() OVER (PARTITION BY result_name
  ORDER BY coalesce(analysis_completed, false) DESC, band_job_directory DESC NULLS LAST, topology_row_id DESC) AS n FROM topology_labels WHERE result_name IS NOT NULL) WHERE n = 1""",
    "best_labelled_row": """
WITH t AS (SELECT DISTINCT result_name FROM topology_labels WHERE analysis_completed),
j AS (SELECT d.candidate_id, d.dft_row_id, d.result_name, t.result_name IS NOT NULL AS h, CASE WHEN isnan(relax_energy_per_atom_ev) THEN NULL ELSE relax_energy_per_atom_ev END AS e
  FROM dft_materials d LEFT JOIN t ON d.result_name = t.result_name WHERE d.candidate_id IS NOT NULL)
SELECT candidate_id, dft_row_id, h AS has_topology FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY h DESC, coalesce(e, 'infinity'::DOUBLE), result_name NULLS FIRST, dft_row_id) AS n FROM j) WHERE n = 1""",
    "relative_energy": """
WITH m AS (SELECT dft_row_id, reduced_formula, coalesce(CASE WHEN static_soc_completed THEN static_soc_energy_per_atom_ev END, CASE WHEN relax_converged THEN relax_energy_per_atom_ev END) AS e FROM dft_materials),
f AS (SELECT *, CASE WHEN isfinite(e) THEN e END AS v FROM m),
g AS (SELECT reduced_formula, min(v) AS lo FROM f WHERE reduced_formula IS NOT NULL GROUP BY 1)
SELECT dft_row_id, round(v - lo, 6) AS relative, v - lo <= 0.1 AS low_energy FROM f LEFT JOIN g ON f.reduced_formula = g.reduced_formula""",
    "exclusion_reasons": """
WITH r AS (SELECT dft_row_id,
  CASE WHEN coalesce(mapping_status <> 'mapped', true) THEN 'not mapped' WHEN NOT coalesce(relax_converged, false) THEN 'relaxation not converged' END AS stability_reason,
  CASE WHEN coalesce(mapping_status <> 'mapped', true) THEN 'not mapped' WHEN NOT coalesce(band_soc_completed, false) THEN 'no band structure'
    WHEN NOT coalesce(irvsp_completed, false) THEN 'no irreps' WHEN NOT band_symmetry_consistent THEN 'symmetry not consistent' END AS topology_reason FROM dft_materials)
SELECT *, stability_reason IS NOT NULL AS excluded_from_stability, topology_reason IS NOT NULL AS excluded_from_topology FROM r WHERE stability_reason IS NOT NULL OR topology_reason IS NOT NULL""",
    "shard_merge_last_wins": """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    "upgrade_merge": """
SELECT p_brand, p_partkey, place, p_size FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS place,
  row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_size >= 25, false) DESC, p_partkey) AS n FROM part) WHERE n = 1""",
    "resume_tasks": """
SELECT DISTINCT result_name FROM dft_materials WHERE result_name IS NOT NULL AND result_name NOT IN (SELECT result_name FROM topology_labels WHERE analysis_completed AND result_name IS NOT NULL)""",
    "relevant_references": "SELECT snapshot_row_id, material_id, reduced_formula FROM reference_snapshot WHERE reduced_formula IN (SELECT reduced_formula FROM structure_catalog WHERE valid_structure)",
    "offset_limit_skip": """
SELECT p_partkey, p_retailprice, CAST(position AS INTEGER) AS position, position IN (45, 60, 61) AS skipped FROM
  (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part) WHERE position BETWEEN 40 AND 159""",
    "first_seen_groups": "SELECT user_id, count(*) AS events, min(event_id) AS first_event, min_by(event_type, event_id) AS first_type FROM events GROUP BY 1",
    "funnel_topk": _SCORED
    + """
SELECT catalog_row_id, candidate_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id, catalog_row_id) AS rank
  FROM s WHERE stoichiometry_valid AND target_spacegroup_match AND is_unique) WHERE rank <= 500""",
    "prefunnel_capped_fill": _SCORED
    + """
, r AS (SELECT *, CASE WHEN stoichiometry_valid THEN 'A' ELSE 'B' END AS tier FROM s WHERE condition_valid AND is_unique AND tp IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY reduced_formula, actual_spacegroup ORDER BY tier, score DESC, candidate_id, catalog_row_id) > 3 AS cap_relaxed FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY cap_relaxed, tier, score DESC, candidate_id, catalog_row_id) AS rank FROM g)
SELECT catalog_row_id, tier, score, cap_relaxed, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 500""",
    "matched_targets": "SELECT reduced_formula, target_spacegroup, least(count(*), 5) AS count FROM structure_catalog WHERE condition_valid AND reduced_formula IS NOT NULL AND target_spacegroup IS NOT NULL GROUP BY 1, 2",
}
