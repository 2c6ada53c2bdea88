"""Numeric kernels, gates, audits and label construction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import evaluate, geometry, quality
from tabulon.plans import model_queries
from tabulon.session import table


def stage_classifier(spark, d):
    p = table(spark, d, "part")
    s = quality.stage_of(F.when(F.col("p_size") % 5 == 0, F.col("p_size")), F.col("p_size") % 7 == 0, F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 2 == 0), F.when(F.col("p_size") % 4 == 0, 11), F.col("p_size") % 3)
    return p.groupBy(s.alias("stage")).agg(F.count(F.lit(1)).alias("jobs"))


def generation_gates(spark, d):
    c = table(spark, d, "structure_catalog")
    gate = quality.generation_gate(F.col("volume_per_atom"), F.col("min_distance_angstrom"), F.col("relax_final_energy_ev"), F.col("target_spacegroup_match"), F.col("element_set_match"))
    return c.groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("records"), F.count_if("relax_converged").alias("converged"))


def index_consistency(spark, d):
    """Particles of a space group that are only confirmed, or only compatible."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL")
    part = lambda c: t.select("spacegroup_number", F.explode(text.tokens(F.col(c))).alias("particle"))
    return quality.set_differences(part("confirmed_particles"), part("compatible_particles"), "spacegroup_number", "particle")


def hard_negatives(spark, d):
    """Per result and particle DP: positive, hard negative (compatible, evaluated, no hit), conflict or excluded."""
    t = table(spark, d, "topology_labels").where("result_name IS NOT NULL")
    names = lambda c: F.array_contains(text.tokens(F.col(c)), "DP")
    kind = (
        F.when(~F.coalesce("analysis_completed", F.lit(False)), "excluded").when(names("confirmed_particles") & ~names("compatible_particles"), "conflict")
        .when(names("confirmed_particles"), "strict_positive").when(names("compatible_particles"), "compatible_hard_negative").otherwise("encyclopedia_negative")
    )
    return t.groupBy(kind.alias("label_kind")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("spacegroup_number").alias("groups"))


def deployment_gate(spark, d):
    """Whether the model may be used: enrichment of the top fifth at least 1.5 and lower bootstrap bound above 1."""
    oof = table(spark, d, "particle_dp_oof_predictions")
    e = evaluate.enrichment_at(oof, "oof_probability", "label", "oof_row_id").select("enrichment")
    b = evaluate.bootstrap_ci(oof, "actual_spacegroup", "oof_probability", "label", draws=2000).select("ci_low")
    return e.crossJoin(b).select("enrichment", "ci_low", (F.coalesce((F.col("enrichment") >= 1.5) & (F.col("ci_low") > 1), F.lit(False))).alias("deployable"))  # one row each


def segment_errors(spark, d):
    """Per space group the mean prediction, and the mean relative deviation of energies of results from their catalogue entry."""
    dft = table(spark, d, "dft_materials").where("candidate_id IS NOT NULL").select("candidate_id", "relax_energy_per_atom_ev", "target_spacegroup")
    cat = table(spark, d, "structure_catalog").groupBy("candidate_id").agg(F.min("relax_energy_per_atom_ev").alias("catalogued"))
    met = dft.join(cat, "candidate_id").where("relax_energy_per_atom_ev IS NOT NULL AND NOT isnan(relax_energy_per_atom_ev) AND catalogued IS NOT NULL AND NOT isnan(catalogued) AND catalogued != 0")
    off = F.abs((F.col("catalogued") - F.col("relax_energy_per_atom_ev")) / F.col("catalogued"))
    return met.groupBy("target_spacegroup").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(off), 5).alias("relative_deviation"))


def compatible_candidates(spark, d):
    """Valid candidates of space groups for which a particle was seen."""
    t = table(spark, d, "topology_labels").select("spacegroup_number", F.explode(text.tokens(F.col("compatible_particles"))).alias("particle")).where("particle = 'TP' AND spacegroup_number IS NOT NULL")
    groups = t.select(F.col("spacegroup_number").alias("actual_spacegroup")).distinct()
    return table(spark, d, "structure_catalog").where("condition_valid").join(groups, "actual_spacegroup", "left_semi").select("catalog_row_id", "candidate_id", "actual_spacegroup")


def potential_steps(spark, d):
    """Events as steps of a sampler: change of the potential from the step before, and the place in the series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.col("value") - F.lag("value", 1, 0.0).over(w)).alias("increment"), (F.row_number().over(w) - 1).alias("place"))


def step_audit(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"), F.count_if(F.col("value") < 1).alias("floor_count"), F.count_distinct("user_id").alias("ancestors"))


def lattice_roundtrip(spark, d):
    """Cell parameters found again from the matrix, the crystal system, and a site found again from its Cartesian place."""
    p = [F.col(f"structure.lattice.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")]
    r = table(spark, d, "reference_snapshot").where("structure IS NOT NULL").select("snapshot_row_id", "spacegroup_number", geometry.lattice_matrix(*p).alias("m"), F.col("structure.sites")[0]["frac_coords"].alias("f"))
    a, b, c, al, be, ga = geometry.matrix_parameters(F.col("m"))
    back = geometry.fractional(geometry.cartesian(F.col("f"), F.col("m")), F.col("m"))
    rounded = {"a": a, "b": b, "c": c, "alpha": al, "beta": be, "gamma": ga, "x": back[0], "y": back[1], "z": back[2]}
    return r.select("snapshot_row_id", geometry.crystal_system(F.col("spacegroup_number")).alias("system"), *[(F.round(v, 4) + 0.0).alias(k) for k, v in rounded.items()])


def wrapped_normal_scores(spark, d):
    return spark.range(0, 200).select(F.col("id").alias("i"), F.round(geometry.wrapped_normal(F.col("id") / 200, F.lit(0.15)), 6).alias("density"), F.round(geometry.wrapped_score(F.col("id") / 200 + 0.0013, F.lit(0.15)), 5).alias("score"))


def sigma_schedule(spark, d):
    return geometry.geometric_schedule(spark, 500, 0.005, 0.5).select("t", F.round("sigma", 7).alias("sigma"))


def index_encodings(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7).alias("k"))
    hot = geometry.one_hot(F.col("k"), 7)
    wave = geometry.sinusoidal(F.col("k") / 7.3, 2)
    return p.select("p_partkey", F.array_join(hot.cast("array<string>"), "").alias("hot"), geometry.argmax(hot).alias("back"), F.round(wave[1], 5).alias("sine"), F.round(wave[3], 5).alias("cosine"))


QUERIES = {
    f.__name__: f
    for f in (stage_classifier, generation_gates, index_consistency, hard_negatives, deployment_gate, segment_errors, compatible_candidates, potential_steps, step_audit, lattice_roundtrip, wrapped_normal_scores, sigma_schedule, index_encodings)
}

_TOK = "SELECT spacegroup_number AS g, trim(unnest(string_split({c}, ';'))) AS p FROM topology_labels WHERE spacegroup_number IS NOT NULL"
ORACLE = {
    "deployment_gate": f"SELECT enrichment, ci_low, coalesce(enrichment >= 1.5 AND ci_low > 1, FALSE) AS deployable FROM ({model_queries.ORACLE['enrichment_top20']}), ({model_queries.ORACLE['group_bootstrap_ci']})",
    "stage_classifier": """
SELECT CASE WHEN p_size % 5 = 0 AND p_size > 0 THEN 'relax' WHEN p_size % 7 = 0 OR (p_size % 3 <> 0 AND p_size % 2 = 0 AND p_size % 4 = 0) THEN 'band_soc' WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN 'static_soc'
  WHEN p_size % 3 = 2 THEN 'one_step_symmetry' ELSE 'static_nosoc' END AS stage, count(*) AS jobs FROM part GROUP BY 1""",
    "generation_gates": """
SELECT CASE WHEN NOT coalesce(isfinite(volume_per_atom), false) OR volume_per_atom < 1 THEN 'bad_volume' WHEN NOT coalesce(isfinite(min_distance_angstrom), false) OR min_distance_angstrom < 0.4 THEN 'too_close'
  WHEN isfinite(relax_final_energy_ev) AND relax_final_energy_ev > 1000 THEN 'energy_too_high' WHEN NOT coalesce(target_spacegroup_match, false) OR NOT coalesce(element_set_match, true) THEN 'not_as_asked'
  WHEN isfinite(relax_final_energy_ev) AND relax_final_energy_ev < -200 THEN 'accepted_unrefined' ELSE 'accepted' END AS gate, count(*) AS records, count(*) FILTER (relax_converged) AS converged FROM structure_catalog GROUP BY 1""",
    "index_consistency": f"""
WITH a AS (SELECT DISTINCT g, p FROM ({_TOK.format(c='confirmed_particles')}) WHERE p <> ''), b AS (SELECT DISTINCT g, p FROM ({_TOK.format(c='compatible_particles')}) WHERE p <> ''),
f AS (SELECT coalesce(a.g, b.g) AS g, a.p AS l, b.p AS r FROM a FULL JOIN b ON a.g = b.g AND a.p = b.p WHERE a.p IS NULL OR b.p IS NULL)
SELECT g AS spacegroup_number, coalesce(string_agg(l, ';' ORDER BY l), '') AS missing, coalesce(string_agg(r, ';' ORDER BY r), '') AS extra FROM f GROUP BY 1""",
    "hard_negatives": """
WITH k AS (SELECT *, coalesce(list_contains(list_transform(string_split(confirmed_particles, ';'), lambda x: trim(x)), 'DP'), false) AS c, coalesce(list_contains(list_transform(string_split(compatible_particles, ';'), lambda x: trim(x)), 'DP'), false) AS m
  FROM topology_labels WHERE result_name IS NOT NULL)
SELECT CASE WHEN NOT coalesce(analysis_completed, false) THEN 'excluded' WHEN c AND NOT m THEN 'conflict' WHEN c THEN 'strict_positive' WHEN m THEN 'compatible_hard_negative' ELSE 'encyclopedia_negative' END AS label_kind,
  count(*) AS rows, count(DISTINCT spacegroup_number) AS groups FROM k GROUP BY 1""",
    "segment_errors": """
WITH c AS (SELECT candidate_id, min(relax_energy_per_atom_ev) AS e FROM structure_catalog GROUP BY 1)
SELECT target_spacegroup, count(*) AS rows, round(avg(abs((c.e - d.relax_energy_per_atom_ev) / c.e)), 5) AS relative_deviation FROM dft_materials d JOIN c USING (candidate_id)
WHERE d.relax_energy_per_atom_ev IS NOT NULL AND NOT isnan(d.relax_energy_per_atom_ev) AND c.e IS NOT NULL AND NOT isnan(c.e) AND c.e <> 0 GROUP BY 1""",
    "compatible_candidates": f"""
SELECT catalog_row_id, candidate_id, actual_spacegroup FROM structure_catalog WHERE condition_valid AND actual_spacegroup IN (SELECT g FROM ({_TOK.format(c='compatible_particles')}) WHERE p = 'TP')""",
    "potential_steps": "SELECT event_id, value - lag(value, 1, 0.0) OVER w AS increment, CAST(row_number() OVER w - 1 AS INTEGER) AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "step_audit": "SELECT event_type, min(value) AS least, round(avg(value), 4) AS mean, max(value) AS most, count(*) FILTER (value < 1) AS floor_count, count(DISTINCT user_id) AS ancestors FROM events GROUP BY 1",
    "lattice_roundtrip": """
SELECT snapshot_row_id, CASE WHEN spacegroup_number < 1 OR spacegroup_number > 230 THEN NULL WHEN spacegroup_number <= 2 THEN 'triclinic' WHEN spacegroup_number <= 15 THEN 'monoclinic' WHEN spacegroup_number <= 74 THEN 'orthorhombic'
  WHEN spacegroup_number <= 142 THEN 'tetragonal' WHEN spacegroup_number <= 167 THEN 'trigonal' WHEN spacegroup_number <= 194 THEN 'hexagonal' WHEN spacegroup_number <= 230 THEN 'cubic' END AS system,
  round(structure.lattice.a, 4) AS a, round(structure.lattice.b, 4) AS b, round(structure.lattice.c, 4) AS c, round(structure.lattice.alpha, 4) AS alpha, round(structure.lattice.beta, 4) AS beta, round(structure.lattice.gamma, 4) AS gamma,
  round(structure.sites[1].frac_coords[1], 4) AS x, round(structure.sites[1].frac_coords[2], 4) AS y, round(structure.sites[1].frac_coords[3], 4) AS z FROM reference_snapshot WHERE structure IS NOT NULL""",
    "wrapped_normal_scores": """
WITH t AS (SELECT i, k, i / 200 + k AS x, i / 200 + 0.0013 + k AS y FROM range(200) a(i), range(-10, 11) b(k))
SELECT i, round(sum(exp(-x * x / 0.045)), 6) AS density, round(sum(-y / 0.0225 * exp(-y * y / 0.045)) / sum(exp(-y * y / 0.045)), 5) AS score FROM t GROUP BY 1""",
    "sigma_schedule": "SELECT i AS t, round(0.005 * pow(100.0::DOUBLE, (i - 1) / 499.0::DOUBLE), 7) AS sigma FROM range(1, 501) r(i)",
    "index_encodings": """
WITH k AS (SELECT p_partkey, p_size % 7 AS k FROM part)
SELECT p_partkey, array_to_string(list_transform(range(7), lambda i: CASE WHEN i = k THEN '1' ELSE '0' END), '') AS hot, k::INTEGER AS back, round(sin(2 * pi() * k / 7.3::DOUBLE), 5) AS sine, round(cos(2 * pi() * k / 7.3::DOUBLE), 5) AS cosine FROM k""",
}
