"""Projections, joins and ordered sets of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import evaluate, lookup, quality, resolve, select, tables
from tabulon.session import table


def assigned_arms(spark, d):
    """Predictions as assignments to arms, joined to their candidate, to known formulas and to band analyses; rates by arm."""
    cat = table(spark, d, "structure_catalog").where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.min("reduced_formula").alias("formula"), F.bool_or("valid_structure").alias("valid"))
    arms = table(spark, d, "particle_dp_oof_predictions").where("label_kind <> ''").select("candidate_id", F.col("label_kind").alias("arm")).distinct()
    known = table(spark, d, "reference_snapshot").where("reduced_formula IS NOT NULL").select(F.col("reduced_formula").alias("formula"), F.lit(False).alias("novel")).distinct()
    labels = table(spark, d, "topology_labels").where("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.bool_or("analysis_completed").alias("analysed"))
    joined = arms.join(cat, "candidate_id").join(known, "formula", "left").join(labels, "candidate_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    measures = {"valid": (yes("valid"), F.lit(True)), "novel": (F.coalesce("novel", F.lit(True)), yes("valid")), "analysed": (yes("analysed"), F.col("analysed").isNotNull())}
    return evaluate.arm_metrics(joined, "arm", measures).select("arm", "metric", "success", "denominator", "rate")


def switchable_targets(spark, d):
    """Candidates by space group under strict and under conditional validity."""
    c = table(spark, d, "structure_catalog")
    one = lambda strict: c.where(tables.validity(strict)).groupBy("target_spacegroup").agg(F.count(F.lit(1)).alias("records")).withColumn("strict", F.lit(strict))
    return one(True).unionByName(one(False))


def kept_files(spark, d):
    """Files that are no standardised or original variants, by collection, numbered by their name as text."""
    from pyspark.sql import Window

    files = table(spark, d, "structure_catalog").where(tables.without_parts(F.col("source_file"), ["_std.cif"], [".orig", "_9"])).groupBy("source_collection").agg(F.count(F.lit(1)).alias("files"), F.min("source_file").alias("first_file"))
    return files.withColumn("place", F.row_number().over(Window.orderBy(F.col("source_collection").cast("string"))))  # one row a collection


def energy_per_atom(spark, d):
    dft = table(spark, d, "dft_materials")
    total = lambda c: F.col(c) * F.col("atom_count")
    return dft.select("dft_row_id", F.round(tables.per_unit([total("static_soc_energy_per_atom_ev"), total("relax_energy_per_atom_ev")], F.col("atom_count")), 6).alias("energy"))


def queue_rows(spark, d):
    """Ranked candidates as rows of a queue: renamed columns, constant stages."""
    c = table(spark, d, "structure_catalog").where("stoichiometry_valid AND relax_energy_per_atom_ev IS NOT NULL AND NOT isnan(relax_energy_per_atom_ev)")
    top = select.top_ranked(c, [F.col("relax_energy_per_atom_ev"), F.col("catalog_row_id")], 500)
    out = tables.renamed_subset(top, {"rank": "rank", "candidate_id": "candidate", "actual_spacegroup": "spacegroup"})
    return tables.with_constants(out, {"stage_1": "relax", "stage_2": "static", "stage_3": "bands"})


def queue_shortfall(spark, d):
    c = table(spark, d, "structure_catalog").where("stoichiometry_valid AND is_unique AND target_spacegroup_match")
    return tables.shortfall(select.top_ranked(c, [F.col("catalog_row_id")], 2000), 2000)


def label_notes(spark, d):
    dft = table(spark, d, "dft_materials")
    return dft.select("dft_row_id", tables.notes({"method": F.col("mapping_method"), "formula": F.col("reduced_formula"), "sg": F.col("relaxed_spacegroup_strict")}).alias("notes"))


def batch_precision(spark, d):
    return tables.batch_scores(table(spark, d, "particle_dp_oof_predictions"), "actual_spacegroup", "oof_probability", "label")


def pass_rate(spark, d):
    """Sources as cases, their first text as answer: the share that tells of energies."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("answer"))
    cases = tables.answered(table(spark, d, "mix_targets").select("source"), first, "source", "answer")
    ok = text.concept_score(F.col("answer"), [["energy", "Energie", "能量"]]) == 1.0
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"))


MARKERS = ("General timing", "FIRE", "converged")


def completion_markers(spark, d):
    """Texts by source that hold any marker of a finished run."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    hit = F.greatest(*[F.col("text").contains(m) for m in MARKERS])
    return docs.groupBy("source").agg(F.count_if(hit).alias("finished"), F.bool_or(hit).alias("any_finished"))


def nearest_reference(spark, d):
    """The reference of the same formula whose formation energy is nearest to each result's relative energy."""
    left = table(spark, d, "dft_materials").where("reduced_formula IS NOT NULL AND relative_energy_per_atom_ev IS NOT NULL AND NOT isnan(relative_energy_per_atom_ev)").select("dft_row_id", "reduced_formula", F.round("relative_energy_per_atom_ev", 6).alias("energy"))
    right = table(spark, d, "reference_snapshot").where("reduced_formula IS NOT NULL AND formation_energy_per_atom IS NOT NULL AND NOT isnan(formation_energy_per_atom)").select("reduced_formula", F.round("formation_energy_per_atom", 6).alias("energy"), "material_id")
    return tables.nearest_value(left, right, ["reduced_formula"], "energy", "material_id", "material_id").select("dft_row_id", "material_id")


ALIASES = ["WNL", "WNL net", "DNL", "DNL net", "DP", "QDP", "TP", "C-1 WP", "WP"]


def alias_counts(spark, d):
    """Particles named in texts and labels, the longest name at each place."""
    t = table(spark, d, "topology_labels").where("compatible_particles IS NOT NULL")
    return t.select(F.explode(F.regexp_extract_all("compatible_particles", F.lit(tables.longest_first(ALIASES)), 0)).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("mentions"))


def particle_groups(spark, d):
    """Particle -> its set of space groups, from pages of range expressions."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL").select("spacegroup_number", F.explode(text.tokens(F.col("compatible_particles"))).alias("particle"))
    pages = t.groupBy("particle").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.col("spacegroup_number"), F.lit("-"), F.col("spacegroup_number") + 1))), ",").alias("expression"))
    return pages.select("particle", F.explode(text.expand_ranges(F.col("expression"))).alias("spacegroup"))


def shards_rederived(spark, d):
    """Catalogue rows and a later shard with corrected parses: the last row of a candidate, its flags derived again."""
    cat = table(spark, d, "structure_catalog").where("candidate_id IS NOT NULL").select("candidate_id", "catalog_row_id", "parse_valid", "geometry_valid", "symmetry_valid", "element_set_match", "formula_match")
    later = cat.where("catalog_row_id % 3 = 0").withColumns({"catalog_row_id": F.col("catalog_row_id") + 1_000_000_000, "geometry_valid": ~F.col("geometry_valid")})
    merged = resolve.last_wins(cat.unionByName(later), ["candidate_id"], "catalog_row_id")
    done = quality.flag_cascade(merged, "parse_valid", "geometry_valid", "symmetry_valid", "element_set_match", "formula_match")
    return done.select("candidate_id", "valid_structure", "condition_valid", "stoichiometry_valid")


def shared_types(spark, d):
    """Event types a user has in each of three parts of the events."""
    e = table(spark, d, "events").withColumn("part", F.col("event_id") % 3)
    return tables.common_values(e, "user_id", F.col("part"), [0, 1, 2], "event_type", "types").select("user_id", F.array_join("types", ";").alias("types"))


def elements_kept(spark, d):
    """Candidates by whether their elements are those asked for."""
    names = lambda c: F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]?)"), 1)
    c = table(spark, d, "structure_catalog")
    return c.groupBy(tables.same_set(names("target_formula"), names("actual_formula")).alias("kept")).agg(F.count(F.lit(1)).alias("records"))


def particles_in_order(spark, d):
    """By space group the particles in order of their first analysis."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL").select("spacegroup_number", "topology_row_id", F.posexplode(text.tokens(F.col("compatible_particles"))).alias("ord", "particle"))
    return tables.first_seen_list(t, ["spacegroup_number"], "particle", ["topology_row_id", "ord"], "particles").select("spacegroup_number", F.array_join("particles", ";").alias("particles"))


def tolerance_sensitive(spark, d):
    """Candidates whose space group depends on the tolerance it is found with; groups that weren't found don't count."""
    c = table(spark, d, "structure_catalog")
    found = F.array_distinct(F.filter(F.array("sg_symprec_001", "sg_symprec_005", "sg_symprec_010"), lambda x: x.isNotNull()))
    return c.groupBy((F.size(found) > 1).alias("sensitive"), F.size(found).alias("groups")).agg(F.count(F.lit(1)).alias("records"), F.count_if("symmetry_tolerance_sensitive").alias("flagged"))


def particles_by_mode(spark, d):
    """Particles of each space group and mode (with spin-orbit coupling or not), confirmed before compatible, a first one replaced by one with paths; and where they come from."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL AND soc IS NOT NULL")
    part = lambda c, k: t.select("spacegroup_number", "soc", F.lit(k).alias("category_ord"), F.posexplode(text.tokens(F.col(c))).alias("ord", "particle"), F.when(F.col("high_symmetry_paths") != "", 1).otherwise(0).alias("has"), "topology_row_id")
    both = part("confirmed_particles", 0).unionByName(part("compatible_particles", 1))
    entries = both.groupBy("spacegroup_number", "soc", "category_ord", "particle").agg(F.min(F.col("topology_row_id") * 100 + F.col("ord")).alias("ord"), F.max("has").alias("has"), F.min("topology_row_id").alias("source_row"))
    merged = lookup.merged_entries(entries.withColumn("paths", F.when(F.col("has") == 1, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))), ["spacegroup_number", "soc"], "particle")
    return merged.select("spacegroup_number", "soc", "particle", F.when(F.col("category_ord") == 0, "essential").otherwise("accidental").alias("category"), (F.col("has") == 1).alias("with_paths"), "source_row")


def counter_edges(spark, d):
    li = table(spark, d, "lineitem")
    return tables.counter_edges(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", "l_suppkey")


def sorted_json(spark, d):
    """By space group the number of analyses of each particle as JSON with sorted keys, and that of DP (0 if it has none)."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL").select("spacegroup_number", F.explode(text.tokens(F.col("compatible_particles"))).alias("particle"))
    n = t.groupBy("spacegroup_number", "particle").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("spacegroup_number").agg(F.map_from_entries(F.collect_list(F.struct("particle", "n"))).alias("m"))
    return m.select("spacegroup_number", tables.sorted_json(F.col("m")).alias("counts"), F.coalesce(F.try_element_at("m", F.lit("DP")), F.lit(0)).alias("dp"))


def stamped_names(spark, d):
    return table(spark, d, "structure_catalog").where("cataloged_at IS NOT NULL").select("catalog_row_id", tables.stamped(F.col("legacy_id"), F.col("cataloged_at")).alias("name"))


def blocks_replaced(spark, d):
    """Texts with the first parenthesis replaced wherever it recurs."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(tables.block_replaced(F.col("text"), r"(?s)\([^()]*\)", "(…)")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (assigned_arms, switchable_targets, kept_files, energy_per_atom, queue_rows, queue_shortfall, label_notes, batch_precision, pass_rate, completion_markers, nearest_reference, alias_counts, particle_groups, shards_rederived, shared_types, elements_kept, particles_in_order, tolerance_sensitive, particles_by_mode, counter_edges, sorted_json, stamped_names, blocks_replaced)
}

_EACH = "SELECT spacegroup_number, topology_row_id, trim(unnest(string_split(compatible_particles, ';'))) AS particle FROM topology_labels WHERE spacegroup_number IS NOT NULL"
ORACLE = {
    "assigned_arms": """
WITH c AS (SELECT candidate_id, min(reduced_formula) AS formula, bool_or(valid_structure) AS valid FROM structure_catalog WHERE candidate_id IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT candidate_id, label_kind AS arm FROM particle_dp_oof_predictions WHERE label_kind <> ''),
l AS (SELECT candidate_id, bool_or(analysis_completed) AS analysed FROM topology_labels GROUP BY 1),
j AS (SELECT arm, coalesce(valid, FALSE) AS valid, NOT EXISTS (SELECT 1 FROM reference_snapshot r WHERE r.reduced_formula = c.formula) AS novel, analysed FROM a JOIN c USING (candidate_id) LEFT JOIN l USING (candidate_id)),
m AS (SELECT arm, 'valid' AS metric, count(*) FILTER (valid) AS success, count(*) AS denominator FROM j GROUP BY 1 UNION ALL SELECT arm, 'novel', count(*) FILTER (valid AND novel), count(*) FILTER (valid) FROM j GROUP BY 1
  UNION ALL SELECT arm, 'analysed', count(*) FILTER (analysed), count(analysed) FROM j GROUP BY 1)
SELECT *, round(success / nullif(denominator, 0), 6) AS rate FROM m""",
    "switchable_targets": "SELECT target_spacegroup, count(*) AS records, TRUE AS strict FROM structure_catalog WHERE stoichiometry_valid GROUP BY 1 UNION ALL SELECT target_spacegroup, count(*), FALSE FROM structure_catalog WHERE condition_valid GROUP BY 1",
    "kept_files": "WITH f AS (SELECT source_collection, count(*) AS files, min(source_file) AS first_file FROM structure_catalog WHERE source_file NOT LIKE '%\\_std.cif' ESCAPE '\\' AND NOT contains(source_file, '.orig') AND NOT contains(source_file, '_9') GROUP BY 1) SELECT *, row_number() OVER (ORDER BY source_collection) AS place FROM f",
    "energy_per_atom": "SELECT dft_row_id, CASE WHEN atom_count <> 0 THEN round(coalesce(CASE WHEN NOT isnan(static_soc_energy_per_atom_ev) THEN static_soc_energy_per_atom_ev * atom_count END, CASE WHEN NOT isnan(relax_energy_per_atom_ev) THEN relax_energy_per_atom_ev * atom_count END) / atom_count, 6) END AS energy FROM dft_materials",
    "queue_rows": "SELECT row_number() OVER (ORDER BY relax_energy_per_atom_ev, catalog_row_id) AS rank, candidate_id AS candidate, actual_spacegroup AS spacegroup, 'relax' AS stage_1, 'static' AS stage_2, 'bands' AS stage_3 FROM structure_catalog WHERE stoichiometry_valid AND relax_energy_per_atom_ev IS NOT NULL AND NOT isnan(relax_energy_per_atom_ev) QUALIFY rank <= 500",
    "queue_shortfall": "SELECT least(n, 2000) AS selected, 2000 AS budget, greatest(2000 - n, 0) AS shortfall FROM (SELECT count(*) AS n FROM structure_catalog WHERE stoichiometry_valid AND is_unique AND target_spacegroup_match)",
    "label_notes": "SELECT dft_row_id, 'method=' || coalesce(nullif(trim(mapping_method), ''), 'unknown') || '; formula=' || coalesce(nullif(trim(reduced_formula), ''), 'unknown') || '; sg=' || coalesce(relaxed_spacegroup_strict::VARCHAR, 'unknown') AS notes FROM dft_materials",
    "batch_precision": """
WITH k AS (SELECT actual_spacegroup AS g, oof_probability >= 0.5 AS h, label = 1 AS t FROM particle_dp_oof_predictions WHERE actual_spacegroup IS NOT NULL AND oof_probability IS NOT NULL AND NOT isnan(oof_probability) AND label IN (0, 1)),
p AS (SELECT g, count(*) FILTER (h AND t) AS tp, count(*) FILTER (h) AS p, count(*) FILTER (t) AS t, count(*) FILTER (h = t) AS same, count(*) AS n FROM k GROUP BY 1)
SELECT count(*) AS batches, round(avg(tp / nullif(p, 0)), 6) AS precision, round(avg(tp / nullif(t, 0)), 6) AS recall, round(avg(same / n), 6) AS accuracy FROM p""",
    "pass_rate": """
WITH a AS (SELECT source, coalesce(arg_min(text, doc_id), '') AS answer FROM documents WHERE source IS NOT NULL GROUP BY 1), c AS (SELECT source, lower(coalesce(answer, '')) AS t FROM mix_targets LEFT JOIN a USING (source)),
p AS (SELECT contains(t, 'energy') OR contains(t, 'energie') OR contains(t, '能量') AS ok FROM c)
SELECT count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 6) AS pass_rate FROM p""",
    "completion_markers": "SELECT source, count(*) FILTER (hit) AS finished, bool_or(hit) AS any_finished FROM (SELECT source, contains(text, 'General timing') OR contains(text, 'FIRE') OR contains(text, 'converged') AS hit FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "nearest_reference": """
WITH l AS (SELECT dft_row_id, reduced_formula, round(relative_energy_per_atom_ev, 6) AS e FROM dft_materials WHERE reduced_formula IS NOT NULL AND relative_energy_per_atom_ev IS NOT NULL AND NOT isnan(relative_energy_per_atom_ev)),
r AS (SELECT reduced_formula, round(formation_energy_per_atom, 6) AS e, min(material_id) AS material_id FROM reference_snapshot WHERE reduced_formula IS NOT NULL AND formation_energy_per_atom IS NOT NULL AND NOT isnan(formation_energy_per_atom) GROUP BY 1, 2)
SELECT dft_row_id, arg_min(material_id, abs(r.e - l.e)) AS material_id FROM l LEFT JOIN r USING (reduced_formula) GROUP BY 1""",
    "alias_counts": "SELECT unnest(regexp_extract_all(compatible_particles, '\\b(?:C-1 WP|DNL net|WNL net|DNL|QDP|WNL|DP|TP|WP)\\b')) AS alias, count(*) AS mentions FROM topology_labels WHERE compatible_particles IS NOT NULL GROUP BY 1",
    "particle_groups": f"SELECT DISTINCT particle, unnest([spacegroup_number, spacegroup_number + 1]) AS spacegroup FROM ({_EACH}) WHERE particle <> ''",
    "shards_rederived": """
WITH u AS (SELECT candidate_id, catalog_row_id AS id, parse_valid AS p, geometry_valid AS g, symmetry_valid AS s, element_set_match AS e, formula_match AS f FROM structure_catalog WHERE candidate_id IS NOT NULL
  UNION ALL SELECT candidate_id, catalog_row_id + 1000000000, parse_valid, NOT geometry_valid, symmetry_valid, element_set_match, formula_match FROM structure_catalog WHERE candidate_id IS NOT NULL AND catalog_row_id % 3 = 0),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY id DESC) = 1),
v AS (SELECT candidate_id, coalesce(p, FALSE) AND coalesce(g, FALSE) AND coalesce(s, FALSE) AS v, coalesce(e, TRUE) AS e, coalesce(f, TRUE) AS f FROM m)
SELECT candidate_id, v AS valid_structure, v AND e AS condition_valid, v AND e AND f AS stoichiometry_valid FROM v""",
    "shared_types": """
WITH p AS (SELECT user_id, event_type, count(DISTINCT event_id % 3) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), s AS (SELECT user_id, string_agg(event_type, ';' ORDER BY event_type) AS t FROM p WHERE n = 3 GROUP BY 1)
SELECT user_id, coalesce(t, '') AS types FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)""",
    "elements_kept": "SELECT list_sort(list_distinct(regexp_extract_all(target_formula, '[A-Z][a-z]?'))) = list_sort(list_distinct(regexp_extract_all(actual_formula, '[A-Z][a-z]?'))) AS kept, count(*) AS records FROM structure_catalog GROUP BY 1",
    "particles_in_order": """
WITH x AS (SELECT spacegroup_number, topology_row_id, string_split(compatible_particles, ';') AS l FROM topology_labels WHERE spacegroup_number IS NOT NULL),
y AS (SELECT spacegroup_number, topology_row_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM x), z AS (SELECT spacegroup_number, trim(p) AS p, min(topology_row_id * 1000 + i) AS o FROM y WHERE trim(p) <> '' GROUP BY 1, 2)
SELECT spacegroup_number, string_agg(p, ';' ORDER BY o) AS particles FROM z GROUP BY 1""",
    "tolerance_sensitive": """
WITH x AS (SELECT len(list_distinct([sg_symprec_001, sg_symprec_005, sg_symprec_010])) AS n, symmetry_tolerance_sensitive AS f FROM structure_catalog)
SELECT n > 1 AS sensitive, n AS groups, count(*) AS records, count(*) FILTER (f) AS flagged FROM x GROUP BY 1, 2""",
    "particles_by_mode": """
WITH t AS (SELECT *, (high_symmetry_paths <> '') IS TRUE AS h FROM topology_labels WHERE spacegroup_number IS NOT NULL AND soc IS NOT NULL),
a AS (SELECT spacegroup_number AS g, soc, 0 AS c, topology_row_id AS r, h, list_filter(list_transform(string_split(confirmed_particles, ';'), lambda p: trim(p)), lambda p: p <> '') AS l FROM t UNION ALL SELECT spacegroup_number, soc, 1, topology_row_id, h, list_filter(list_transform(string_split(compatible_particles, ';'), lambda p: trim(p)), lambda p: p <> '') FROM t),
u AS (SELECT g, soc, c, r, h, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM a),
e AS (SELECT g, soc, c, p, min(r * 100 + i) AS o, bool_or(h) AS h, min(r) AS s FROM u GROUP BY 1, 2, 3, 4)
SELECT g AS spacegroup_number, soc, p AS particle, CASE WHEN c = 0 THEN 'essential' ELSE 'accidental' END AS category, h AS with_paths, s AS source_row FROM e QUALIFY row_number() OVER (PARTITION BY g, soc, p ORDER BY h DESC, c, o) = 1""",
    "counter_edges": """
WITH e AS (SELECT l_orderkey, l_partkey AS i, l_suppkey AS j, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, k AS place, i, j FROM e UNION ALL SELECT l_orderkey, k + n, j, i FROM e""",
    "sorted_json": f"""
WITH n AS (SELECT spacegroup_number, particle, count(*) AS n FROM ({_EACH}) WHERE particle <> '' GROUP BY 1, 2)
SELECT spacegroup_number, '{{' || string_agg('"' || particle || '":' || n, ',' ORDER BY particle) || '}}' AS counts, coalesce(sum(n) FILTER (particle = 'DP'), 0)::BIGINT AS dp FROM n GROUP BY 1""",
    "stamped_names": "SELECT catalog_row_id, concat_ws('_', legacy_id, strftime(cataloged_at, '%Y%m%d_%H%M%S')) AS name FROM structure_catalog WHERE cataloged_at IS NOT NULL",
    "blocks_replaced": "WITH b AS (SELECT doc_id, text, regexp_extract(text, '\\([^()]*\\)') AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(CASE WHEN b = '' THEN text ELSE replace(text, b, '(…)') END) AS digest FROM b",
}
