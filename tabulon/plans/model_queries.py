"""Evaluation, duplicates, sampling, geometry and learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import formulas
from tabulon.operators import dedup, evaluate, geometry, learn, sampling
from tabulon.operators.orphans import reference_value
from tabulon.session import table
from tabulon.workspace import Workspace


def _oof(spark, d):
    return table(spark, d, "particle_dp_oof_predictions")


def _arms(spark, d):
    cat = table(spark, d, "structure_catalog")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    every = F.lit(True)
    measures = {
        "valid": (yes("valid_structure"), every), "condition": (yes("condition_valid"), every), "spacegroup": (yes("target_spacegroup_match"), yes("valid_structure")),
        "unique": (yes("is_unique"), yes("condition_valid") & F.col("is_unique").isNotNull()), "converged": (yes("relax_converged"), F.col("relax_converged").isNotNull()),
    }
    return evaluate.arm_metrics(cat, "selected_stage", measures)


def arm_metrics(spark, d):
    return _arms(spark, d)


def lift_vs_baseline(spark, d):
    return evaluate.lift(_arms(spark, d), "selected_stage", "generated").select("selected_stage", "metric", "rate", "lift")


def auc_ap_brier(spark, d):
    return evaluate.ranking_metrics(spark, _oof(spark, d), "oof_probability", "label")


def auc_ap_brier_sg194(spark, d):
    return evaluate.ranking_metrics(spark, _oof(spark, d).where("actual_spacegroup = 194"), "oof_probability", "label")


def enrichment_top20(spark, d):
    return evaluate.enrichment_at(_oof(spark, d), "oof_probability", "label", "oof_row_id")


def group_bootstrap_ci(spark, d):
    return evaluate.bootstrap_ci(_oof(spark, d), "actual_spacegroup", "oof_probability", "label", draws=2000)


def top_share_ci(spark, d):
    """The interval of the top fifth's enrichment over 2000 resamplings of the groups."""
    return evaluate.bootstrap_top_ci(_oof(spark, d), "actual_spacegroup", "oof_probability", "label")


def stratified_folds(spark, d):
    """Folds of chemical systems, with labels alike; checked by their totals."""
    rows = _oof(spark, d).withColumn("grp", formulas.chemical_system(F.col("chemical_system")))
    return evaluate.stratified_folds(rows, "grp", "label")


def fold_totals(spark, d):
    """One row: folds, systems and rows placed, and whether each fold's share of positives is that of all to within 2 in 100."""
    by = stratified_folds(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("g"), F.sum("rows").alias("r"), F.sum("positives").alias("p"))
    whole = by.agg(F.sum("p").alias("all_p"), F.sum("r").alias("all_r"))
    met = by.crossJoin(F.broadcast(whole)).withColumn("ok", F.abs(F.col("p") / F.col("r") - F.col("all_p") / F.col("all_r")) <= 0.02)
    return met.agg(F.count(F.lit(1)).alias("folds"), F.sum("g").alias("systems"), F.sum("r").alias("rows"), F.bool_and("ok").alias("alike"))


def group_folds(spark, d):
    return evaluate.group_folds(_oof(spark, d), "actual_spacegroup", "label")


def exact_dup_hash(spark, d):
    cat = table(spark, d, "structure_catalog").select("catalog_row_id", "reduced_formula", "actual_spacegroup", "atom_count", "canonical_name", "condition_valid")
    done = dedup.exact_duplicates(cat, ["reduced_formula", "actual_spacegroup", "atom_count"], F.col("canonical_name"), "catalog_row_id", F.col("condition_valid") & F.col("canonical_name").isNotNull())
    return done


def text_hashes(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.left(F.sha2("text", 256), F.lit(12)).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def leader_clusters(spark, d):
    e = table(spark, d, "embeddings")
    return dedup.leader_clusters(e, "label", "vec_id", "embedding", 0.3)


def blocked_novelty(spark, d):
    """Candidates against references of their formula, the same if space group and atoms per formula agree."""
    cat = table(spark, d, "structure_catalog").select("catalog_row_id", "reduced_formula", "actual_spacegroup", "valid_structure")
    ref = table(spark, d, "reference_snapshot").where("reduced_formula IS NOT NULL").select("material_id", "reduced_formula", "spacegroup_number")
    return dedup.novelty(cat, ref, "reduced_formula", [("actual_spacegroup", "spacegroup_number")], "catalog_row_id", "material_id", F.col("valid_structure"))


def weighted_features(spark, d):
    li = table(spark, d, "lineitem")
    x, w = F.col("l_extendedprice"), F.col("l_quantity")
    return li.groupBy("l_orderkey").agg((F.round(F.sum(w * x), 2) / F.sum(w)).alias("weighted_mean"), F.round(F.stddev_pop(x), 4).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("most"), F.count_distinct("l_suppkey").alias("suppliers"))


def nan_scaler(spark, d):
    dft = table(spark, d, "dft_materials").select("dft_row_id", "relax_energy_per_atom_ev", F.col("atom_count").cast("double").alias("atom_count"))
    done = geometry.scaled(dft, ["relax_energy_per_atom_ev", "atom_count"])
    return done.select("dft_row_id", F.round("relax_energy_per_atom_ev_scaled", 5).alias("energy_scaled"), F.round("atom_count_scaled", 5).alias("atoms_scaled"))


def _weights(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("particle"), (F.col("s_acctbal") / 1000).alias("log_weight"))
    return sampling.normalised_weights(s, ["run"], "log_weight")


def smc_weights_ess(spark, d):
    return sampling.effective_size(_weights(spark, d), ["run"], "weight").select("run", "particles", F.round("ess", 5).alias("ess"))


def systematic_resample(spark, d):
    return sampling.systematic_resample(_weights(spark, d), ["run"], "particle", "weight", 0.37)


def categorical_draw(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    draws = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", ((F.col("o_orderkey") * 7919 + 13) % 1000 / 1000.0).alias("u"))
    return sampling.draw_categories(draws, counts, ["o_orderpriority"], "o_orderstatus", "n", "u").select("o_orderkey", "o_orderstatus")


def conditional_marginals(spark, d):
    return sampling.conditional_marginals(table(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase", "signup"])


def tempered_power(spark, d):
    return spark.range(0, 501).select(F.col("id").alias("step"), F.round(sampling.tempered_power(F.col("id"), 100, 450, 3.0), 6).alias("beta"))


def lattice_volume(spark, d):
    p = [F.col(f"structure.lattice.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")]
    return table(spark, d, "reference_snapshot").where("structure IS NOT NULL").select("snapshot_row_id", F.round(geometry.volume(*p), 4).alias("volume"), F.size("structure.sites").alias("sites"))


def pbc_min_distance(spark, d):
    return geometry.least_distance(table(spark, d, "reference_snapshot"), "snapshot_row_id", "structure").select("snapshot_row_id", F.round("least_distance", 5).alias("least_distance"))


def pbc_neighbours(spark, d):
    near = geometry.nearest_neighbours(geometry.neighbour_pairs(table(spark, d, "reference_snapshot"), "snapshot_row_id", "structure"), "snapshot_row_id", 4)
    return near.groupBy("snapshot_row_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.max("distance"), 4).alias("longest"))


def edge_symmetrise(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).distinct()
    return geometry.symmetric_edges(e)


def noise_schedule(spark, d):
    return geometry.cosine_schedule(spark, 500).select("t", F.round("beta", 6).alias("beta"), F.round("alpha_bar", 6).alias("alpha_bar"))


def fractional_wrap(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 7 - 3).alias("x"), (F.col("value") / 11).alias("y"))
    return e.select("event_id", F.round(geometry.wrap(F.col("x")), 5).alias("wrapped"), F.round(geometry.periodic_gap(F.col("x"), F.col("y")), 5).alias("gap"))


def _features(spark, d):
    """Every prediction with its candidate's measures, null where the catalogue doesn't know the candidate."""
    names = [f"{p}_{s}" for p in formulas.PROPERTIES for s in ("weighted_mean", "std", "min", "max")]
    measures = ("atom_count", "element_count", "volume_per_atom", "density_g_cm3", "min_distance_angstrom")
    cat = table(spark, d, "structure_catalog").groupBy(reference_value("candidate_id").alias("key")).agg(F.min("reduced_formula").alias("formula"), *[F.max(c).cast("double").alias(c) for c in measures]).where("key IS NOT NULL")
    ws = Workspace(spark, "features")
    cat = ws.stage(cat)
    kinds, numbers = formulas.formula_parts(F.col("formula"))
    parts = ws.stage(cat.select("formula").where("formula IS NOT NULL").distinct().withColumns({"kinds": kinds, "numbers": numbers}))  # each formula is read once, not once a candidate or statistic
    stats = formulas.composition_statistics(F.col("kinds"), F.col("numbers"))
    by_formula = parts.select("formula", *[stats[n].alias(n) for n in names])
    rows = _oof(spark, d).select("oof_row_id", "candidate_id", "label", F.coalesce(formulas.chemical_system(F.col("chemical_system")), F.lit("none")).alias("grp"), F.col("actual_spacegroup").cast("double").alias("spacegroup"))
    return rows.withColumn("key", reference_value("candidate_id")).join(cat, "key", "left").join(by_formula, "formula", "left").drop("key", "formula")


FEATURES = ["atom_count", "element_count", "volume_per_atom", "density_g_cm3", "min_distance_angstrom", "spacegroup", *[f"{p}_{s}" for p in formulas.PROPERTIES for s in ("weighted_mean", "std", "min", "max")]]


def structure_features(spark, d):
    """Features of reference structures: those of the cell, and of the numbers and periods of their elements."""
    rows, _ = learn.structure_features(table(spark, d, "reference_snapshot").where("structure IS NOT NULL"), "snapshot_row_id", "structure", "spacegroup_number")
    chosen = ("atom_count", "element_count", "spacegroup_number", "lattice_a", "gamma", "number_weighted_mean", "number_std", "number_min", "number_max", "period_min", "period_max", "period_std")
    return rows.select("snapshot_row_id", F.round("volume_per_atom", 4).alias("volume_per_atom"), *[F.round(c, 5).alias(c) for c in chosen])


def rf_oof_scores(spark, d):
    """Out-of-fold probabilities of a class-weighted forest with folds by system, calibrated on them."""
    return learn.out_of_fold(spark, _features(spark, d), "oof_row_id", "grp", "label", FEATURES, folds=5, trees=600)


def tree_uncertainty(spark, d):
    """Probability and its spread over trees for every row; rows with unusable features get an error."""
    return learn.scored_with_uncertainty(spark, _features(spark, d), "oof_row_id", "label", FEATURES, trees=600)


QUERIES = {
    f.__name__: f
    for f in (arm_metrics, lift_vs_baseline, auc_ap_brier, auc_ap_brier_sg194, enrichment_top20, group_bootstrap_ci, top_share_ci, stratified_folds, fold_totals, group_folds, exact_dup_hash, text_hashes, leader_clusters, blocked_novelty, weighted_features, nan_scaler, smc_weights_ess, systematic_resample, categorical_draw, conditional_marginals, tempered_power, lattice_volume, pbc_min_distance, pbc_neighbours, edge_symmetrise, noise_schedule, fractional_wrap, structure_features, rf_oof_scores, tree_uncertainty)
}

_ARMS = """
WITH w AS (SELECT selected_stage, count(*) AS n, count(*) FILTER (valid_structure) AS v, count(*) FILTER (condition_valid) AS c, count(*) FILTER (valid_structure AND target_spacegroup_match) AS g,
  count(*) FILTER (condition_valid AND is_unique IS NOT NULL) AS un, count(*) FILTER (condition_valid AND is_unique) AS u, count(*) FILTER (relax_converged) AS r, count(*) FILTER (relax_converged IS NOT NULL) AS rn
  FROM structure_catalog WHERE selected_stage <> '' GROUP BY 1),
l AS (SELECT selected_stage, 'valid' AS metric, v AS success, n AS denominator FROM w UNION ALL SELECT selected_stage, 'condition', c, n FROM w UNION ALL SELECT selected_stage, 'spacegroup', g, v FROM w
  UNION ALL SELECT selected_stage, 'unique', u, un FROM w UNION ALL SELECT selected_stage, 'converged', r, rn FROM w),
p AS (SELECT *, success / nullif(denominator, 0) AS p, nullif(denominator, 0)::DOUBLE AS m FROM l),
a AS (SELECT selected_stage, metric, success, denominator, round(p, 6) AS rate,
  CASE WHEN m IS NOT NULL THEN round(greatest(0, (p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m)), 6) END AS ci_low,
  CASE WHEN m IS NOT NULL THEN round(least(1, (p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m)), 6) END AS ci_high FROM p)
"""
_RANK = """
WITH k AS (SELECT oof_probability AS s, label AS y FROM particle_dp_oof_predictions WHERE oof_probability IS NOT NULL AND NOT isnan(oof_probability) AND label IN (0, 1) {extra}),
t AS (SELECT s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM k GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT sum(pos) AS p, sum(neg) AS n FROM t)
SELECT (SELECT count(*) FROM k) AS rows, round(any_value(p) / (any_value(p) + any_value(n)), 6) AS base_rate, round(sum(neg * (tp - pos / 2)) / any_value(p * n), 6) AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / any_value(p), 6) AS average_precision,
  round((sum(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) / any_value(p) + sum(CASE WHEN s < 0.5 THEN neg ELSE 0 END) / any_value(n)) / 2, 6) AS balanced_accuracy,
  round(sum(pos * (s - 1) * (s - 1) + neg * s * s) / sum(pos + neg), 6) AS brier FROM c, g"""
_SITES = """
WITH st AS (SELECT snapshot_row_id AS id, structure.lattice AS l, structure.sites AS z FROM reference_snapshot WHERE structure IS NOT NULL),
cc AS (SELECT id, z, l.a AS a, l.b AS b, l.c AS c, cos(radians(l.alpha)) AS ca, cos(radians(l.beta)) AS cb, cos(radians(l.gamma)) AS cg, sin(radians(l.alpha)) AS sa, sin(radians(l.beta)) AS sb FROM st),
mm AS (SELECT *, acos(least(greatest((ca * cb - cg) / (sa * sb), -1), 1)) AS gs FROM cc),
m AS (SELECT id, z, a * sb AS m00, 0.0::DOUBLE AS m01, a * cb AS m02, -b * sa * cos(gs) AS m10, b * sa * sin(gs) AS m11, b * ca AS m12, c AS m22 FROM mm),
u AS (SELECT *, unnest(z) AS s, unnest(range(len(z))) AS i FROM m),
x AS (SELECT id, i, m00, m01, m02, m10, m11, m12, m22, s.frac_coords[1] * m00 + s.frac_coords[2] * m10 AS x, s.frac_coords[1] * m01 + s.frac_coords[2] * m11 AS y, s.frac_coords[1] * m02 + s.frac_coords[2] * m12 + s.frac_coords[3] * m22 AS w FROM u),
im AS (SELECT a.r AS p, b.r AS q, c.r AS r FROM range(-1, 2) a(r), range(-1, 2) b(r), range(-1, 2) c(r)),
pr AS (SELECT a.id, a.i, b.i AS j, p, q, r, sqrt((b.x + p * a.m00 + q * a.m10 - a.x) ** 2 + (b.y + q * a.m11 - a.y) ** 2 + (b.w + p * a.m02 + q * a.m12 + r * a.m22 - a.w) ** 2) AS d
  FROM x a JOIN x b ON a.id = b.id, im WHERE a.i <> b.i OR p <> 0 OR q <> 0 OR r <> 0)
"""

_Z = "[" + ", ".join(f"'{e}'" for e in formulas.ELEMENTS) + "]"
ORACLE = {
    "structure_features": f"""
WITH e AS (SELECT snapshot_row_id, spacegroup_number, structure.lattice AS l, len(structure.sites) AS n, list_transform(structure.sites, lambda s: list_position({_Z}, s.element)) AS z FROM reference_snapshot WHERE structure IS NOT NULL),
d AS (SELECT *, list_distinct(z) AS k FROM e), p AS (SELECT *, list_transform(k, lambda x: CASE WHEN x <= 2 THEN 1 WHEN x <= 10 THEN 2 WHEN x <= 18 THEN 3 WHEN x <= 36 THEN 4 WHEN x <= 54 THEN 5 WHEN x <= 86 THEN 6 ELSE 7 END) AS q FROM d)
SELECT snapshot_row_id, round(l.a * l.b * l.c * sqrt(greatest(1 - cos(radians(l.alpha)) ** 2 - cos(radians(l.beta)) ** 2 - cos(radians(l.gamma)) ** 2 + 2 * cos(radians(l.alpha)) * cos(radians(l.beta)) * cos(radians(l.gamma)), 0)) / n, 4) AS volume_per_atom,
  n::DOUBLE AS atom_count, len(k)::DOUBLE AS element_count, spacegroup_number::DOUBLE AS spacegroup_number, round(l.a, 5) AS lattice_a, round(l.gamma, 5) AS gamma, round(list_avg(z), 5) AS number_weighted_mean, round(list_stddev_pop(k), 5) AS number_std, list_min(k)::DOUBLE AS number_min, list_max(k)::DOUBLE AS number_max,
  list_min(q)::DOUBLE AS period_min, list_max(q)::DOUBLE AS period_max, round(list_stddev_pop(q), 5) AS period_std FROM p""",
    "arm_metrics": _ARMS + "SELECT * FROM a",
    "lift_vs_baseline": _ARMS + "SELECT a.selected_stage, a.metric, a.rate, round(a.rate / nullif(b.rate, 0), 6) AS lift FROM a LEFT JOIN a b ON a.metric = b.metric AND b.selected_stage = 'generated'",
    "auc_ap_brier": _RANK.format(extra=""),
    "auc_ap_brier_sg194": _RANK.format(extra="AND actual_spacegroup = 194"),
    "enrichment_top20": """
WITH k AS (SELECT *, row_number() OVER (ORDER BY oof_probability DESC, oof_row_id) AS n, count(*) OVER () AS t, avg(label) OVER () AS b FROM particle_dp_oof_predictions
  WHERE oof_probability IS NOT NULL AND NOT isnan(oof_probability) AND label IN (0, 1))
SELECT count(*) AS selected, round(avg(label), 6) AS precision, round(any_value(b), 6) AS base_rate, round(avg(label) / any_value(b), 6) AS enrichment FROM k WHERE n <= greatest(1, ceil(0.2 * t))""",
    "group_bootstrap_ci": """
WITH k AS (SELECT * FROM particle_dp_oof_predictions WHERE actual_spacegroup IS NOT NULL AND oof_probability IS NOT NULL AND NOT isnan(oof_probability) AND label IN (0, 1)),
g AS (SELECT row_number() OVER (ORDER BY actual_spacegroup) - 1 AS g, count(*) AS n, sum(label) AS p, count(*) FILTER (oof_probability >= 0.5) AS s, sum(CASE WHEN oof_probability >= 0.5 THEN label ELSE 0 END) AS sp FROM k GROUP BY actual_spacegroup),
c AS (SELECT count(*) AS c FROM g),
d AS (SELECT i // c AS draw, ((i + 13) * 1103515245 + 12345) % 2147483648 * 48271 % 2147483647 % c AS g FROM c, range(2000 * (SELECT c FROM c)) r(i)),
e AS (SELECT (sum(sp) / nullif(sum(s), 0)) / nullif(sum(p) / sum(n), 0) AS e FROM d JOIN g ON d.g = g.g GROUP BY draw)
SELECT count(*) AS draws, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high FROM e WHERE e IS NOT NULL""",
    "top_share_ci": """
WITH k AS (SELECT actual_spacegroup AS a, round(oof_probability, 3) AS s, label FROM particle_dp_oof_predictions WHERE actual_spacegroup IS NOT NULL AND oof_probability IS NOT NULL AND NOT isnan(oof_probability) AND label IN (0, 1)),
h AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS g FROM (SELECT DISTINCT a FROM k)), c AS (SELECT count(*) AS c FROM h),
t AS (SELECT g, s, count(*) AS n, sum(label) AS p FROM k JOIN h USING (a) GROUP BY 1, 2),
d AS (SELECT i // c AS draw, ((i + 13) * 1103515245 + 12345) % 2147483648 * 48271 % 2147483647 % c AS g FROM c, range(2000 * (SELECT c FROM c)) r(i)),
u AS (SELECT draw, g, count(*) AS k FROM d GROUP BY 1, 2), x AS (SELECT draw, s, sum(k * n) AS n, sum(k * p) AS p FROM u JOIN t USING (g) GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY draw ORDER BY s DESC) AS upto, sum(n) OVER (PARTITION BY draw) AS nn, sum(p) OVER (PARTITION BY draw) AS pp FROM x),
y AS (SELECT *, greatest(1, ceil(nn * 0.2::DOUBLE)) AS q FROM r), z AS (SELECT draw, sum(p * least(greatest(q - (upto - n), 0), n) / n) AS hit, max(q) AS q, max(nn) AS nn, max(pp) AS pp FROM y GROUP BY 1),
e AS (SELECT hit / q / nullif(pp / nn, 0) AS e FROM z)
SELECT count(*) AS draws, round(quantile_cont(e, 0.025), 6) AS ci_low, round(quantile_cont(e, 0.975), 6) AS ci_high FROM e WHERE e IS NOT NULL""",
    "fold_totals": """
WITH x AS (SELECT label, list_filter(string_split_regex(chemical_system, '[^A-Za-z]+'), lambda t: t <> '') AS parts FROM particle_dp_oof_predictions WHERE label IN (0, 1)),
y AS (SELECT label, CASE WHEN len(parts) <> 1 OR regexp_full_match(parts[1], '[a-z]{1,2}') THEN parts ELSE regexp_extract_all(parts[1], '[A-Z][a-z]?') END AS symbols FROM x),
z AS (SELECT label, nullif(array_to_string(list_sort(list_distinct(list_transform(symbols, lambda t: upper(t[1]) || lower(t[2:])))), '-'), '') AS s FROM y)
SELECT 5 AS folds, count(DISTINCT s) AS systems, count(s) AS rows, TRUE AS alike FROM z""",
    "group_folds": """
WITH b AS (SELECT actual_spacegroup, count(*) AS rows, sum(label)::BIGINT AS positives FROM particle_dp_oof_predictions WHERE actual_spacegroup IS NOT NULL AND label IN (0, 1) GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY positives DESC, rows DESC, actual_spacegroup) - 1 AS n FROM b)
SELECT actual_spacegroup, rows, positives, CAST(CASE WHEN (n // 5) % 2 = 0 THEN n % 5 ELSE 4 - n % 5 END AS INTEGER) AS fold FROM n""",
    "exact_dup_hash": """
WITH r AS (SELECT *, coalesce(condition_valid AND canonical_name IS NOT NULL, false) AS e FROM structure_catalog),
f AS (SELECT *, min(catalog_row_id) FILTER (e) OVER (PARTITION BY reduced_formula, actual_spacegroup, atom_count, canonical_name) AS m FROM r)
SELECT catalog_row_id, CASE WHEN e AND m <> catalog_row_id THEN m END AS duplicate_of, CASE WHEN e THEN m = catalog_row_id END AS is_unique FROM f""",
    "text_hashes": "SELECT left(sha256(text), 12) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "blocked_novelty": """
WITH n AS (SELECT reduced_formula, count(*) AS n FROM reference_snapshot WHERE reduced_formula IS NOT NULL GROUP BY 1),
h AS (SELECT catalog_row_id, string_agg(DISTINCT material_id, ';' ORDER BY material_id) AS ids FROM structure_catalog c JOIN reference_snapshot r ON c.reduced_formula = r.reduced_formula AND actual_spacegroup = spacegroup_number WHERE valid_structure GROUP BY 1),
j AS (SELECT c.catalog_row_id, coalesce(n, 0) AS reference_count, coalesce(ids, '') AS matched_ids, CASE WHEN NOT coalesce(valid_structure, false) THEN 'not_evaluated_invalid' WHEN n IS NULL THEN 'composition_novel'
  WHEN ids IS NULL THEN 'structure_novel' ELSE 'matched' END AS novelty_status FROM structure_catalog c LEFT JOIN n ON c.reduced_formula = n.reduced_formula LEFT JOIN h ON c.catalog_row_id = h.catalog_row_id)
SELECT *, CASE WHEN novelty_status <> 'not_evaluated_invalid' THEN novelty_status <> 'matched' END AS is_novel FROM j""",
    "weighted_features": """
SELECT l_orderkey, round(sum(l_quantity * l_extendedprice), 2) / sum(l_quantity) AS weighted_mean, round(stddev_pop(l_extendedprice), 4) AS deviation, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
  count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""",
    "nan_scaler": """
WITH c AS (SELECT dft_row_id, CASE WHEN NOT isnan(relax_energy_per_atom_ev) THEN relax_energy_per_atom_ev END AS e, atom_count::DOUBLE AS a FROM dft_materials),
s AS (SELECT avg(e) AS em, stddev_pop(e) AS es, avg(a) AS am, stddev_pop(a) AS sd FROM c)
SELECT dft_row_id, round(coalesce((e - em) / es, 0), 5) AS energy_scaled, round(coalesce((a - am) / sd, 0), 5) AS atoms_scaled FROM c, s""",
    "smc_weights_ess": """
WITH e AS (SELECT s_nationkey AS run, exp(s_acctbal / 1000 - max(s_acctbal / 1000) OVER (PARTITION BY s_nationkey)) AS e FROM supplier),
w AS (SELECT run, e / sum(e) OVER (PARTITION BY run) AS w FROM e)
SELECT run, count(*) AS particles, round(1 / sum(w * w), 5) AS ess FROM w GROUP BY 1""",
    "systematic_resample": """
WITH e AS (SELECT s_nationkey AS run, s_suppkey AS particle, exp(s_acctbal / 1000 - max(s_acctbal / 1000) OVER (PARTITION BY s_nationkey)) AS e FROM supplier),
w AS (SELECT run, particle, e / sum(e) OVER (PARTITION BY run) AS w, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY particle) AS k FROM e),
c AS (SELECT *, CASE WHEN k = n THEN 1.0 ELSE sum(w) OVER (PARTITION BY run ORDER BY particle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS hi FROM w),
b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY run ORDER BY particle), 0) AS lo FROM c)
SELECT run, CAST(s AS INTEGER) AS slot, particle AS ancestor FROM b, range(1000) r(s) WHERE s < n AND (s + 0.37) / n >= lo AND (s + 0.37) / n < hi""",
    "categorical_draw": """
WITH t AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT p, s, sum(n) OVER (PARTITION BY p ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER (PARTITION BY p) AS hi FROM t),
d AS (SELECT o_orderkey, o_orderpriority AS p, (o_orderkey * 7919 + 13) % 1000 / 1000.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, min_by(s, hi) AS o_orderstatus FROM d JOIN c ON d.p = c.p AND c.hi > d.u GROUP BY 1""",
    "conditional_marginals": """
WITH v AS (SELECT unnest(['view', 'click', 'purchase', 'signup']) AS event_type), u AS (SELECT DISTINCT user_id FROM events),
n AS (SELECT user_id, event_type, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = v.event_type) AS n FROM u, v)
SELECT user_id, event_type, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY user_id), 0), 0.25), 6) AS probability FROM n""",
    "tempered_power": "SELECT i AS step, round(3.0 * least(greatest((i - 100) / 350.0::DOUBLE, 0), 1), 6) AS beta FROM range(501) r(i)",
    "lattice_volume": """
WITH l AS (SELECT snapshot_row_id, structure.lattice AS l, len(structure.sites) AS n FROM reference_snapshot WHERE structure IS NOT NULL),
c AS (SELECT *, cos(radians(l.alpha)) AS x, cos(radians(l.beta)) AS y, cos(radians(l.gamma)) AS z FROM l)
SELECT snapshot_row_id, round(l.a * l.b * l.c * sqrt(greatest(1 - x * x - y * y - z * z + 2 * x * y * z, 0)), 4) AS volume, n::INTEGER AS sites FROM c""",
    "pbc_min_distance": _SITES + "SELECT id AS snapshot_row_id, round(min(d), 5) AS least_distance FROM pr GROUP BY 1",
    "pbc_neighbours": _SITES
    + """
, k AS (SELECT *, nth_value(d, 5) OVER (PARTITION BY id, i ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM pr)
SELECT id AS snapshot_row_id, count(*) AS edges, round(max(d), 4) AS longest FROM k WHERE cut IS NULL OR d * d < cut * cut + 0.01 GROUP BY 1""",
    "edge_symmetrise": "WITH e AS (SELECT DISTINCT l_partkey AS i, l_suppkey AS j FROM lineitem), o AS (SELECT * FROM e WHERE i < j) SELECT i, j FROM o UNION ALL SELECT j, i FROM o",
    "noise_schedule": """
WITH t AS (SELECT i AS t, cos((i / 500 + 0.008) / 1.008 * pi() / 2) ** 2 AS f, cos(((i - 1) / 500 + 0.008) / 1.008 * pi() / 2) ** 2 AS g FROM range(1, 501) r(i)),
b AS (SELECT t, least(greatest(1 - f / g, 1e-4), 0.9999) AS b FROM t)
SELECT t, round(b, 6) AS beta, round(exp(sum(ln(1 - b)) OVER (ORDER BY t)), 6) AS alpha_bar FROM b""",
    "fractional_wrap": """
WITH e AS (SELECT event_id, value / 7 - 3 AS x, value / 11 AS y FROM events), d AS (SELECT *, (x - y) - floor(x - y) AS d FROM e)
SELECT event_id, round(x - floor(x), 5) AS wrapped, round(least(d, 1 - d), 5) AS gap FROM d""",
}
