"""Flags, classes and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.semantics import lenient_bool, lenient_float, lenient_int, switch_bool
from tabulon.operators import quality
from tabulon.session import table

FLAGS = ["parse_valid", "geometry_valid", "symmetry_valid", "valid_structure", "condition_valid", "element_set_match", "stoichiometry_valid", "target_spacegroup_match", "symmetry_tolerance_sensitive", "relax_diverged", "is_unique"]


def _lineitem_flags() -> dict:
    return {
        "large": F.col("l_quantity") >= 25,
        "discounted": F.col("l_discount") > 0.05,
        "taxed": F.when(F.col("l_tax") == 0, None).otherwise(F.col("l_tax") > 0.04),
        "filled": F.col("l_linestatus") == "F",
    }


def group_quality_rates(spark, d):
    return quality.group_rates(table(spark, d, "lineitem"), F.col("l_returnflag"), "returnflag", _lineitem_flags(), 6)


def catalog_flag_summary(spark, d):
    return quality.flag_counts(table(spark, d, "structure_catalog"), {f: F.col(f) for f in FLAGS})


def catalog_group_rates(spark, d):
    return quality.group_rates(table(spark, d, "structure_catalog"), F.col("target_spacegroup"), "spacegroup", {f: F.col(f) for f in FLAGS}, 6)


def classification_histogram(spark, d):
    c = quality.classification(F.col("parse_valid"), F.col("symmetry_valid"), F.col("geometry_valid"), F.col("element_set_match"), F.col("target_spacegroup_match"))
    return quality.histogram(table(spark, d, "structure_catalog"), c, "class")


def flag_cascade(spark, d):
    cat = table(spark, d, "structure_catalog").drop("valid_structure", "condition_valid", "stoichiometry_valid")
    geometry = quality.geometry_valid(F.col("volume_per_atom") * F.col("atom_count"), F.col("min_distance_angstrom"), F.col("volume_per_atom"))
    done = quality.flag_cascade(cat.withColumn("geometry_ok", geometry), "parse_valid", "geometry_ok", "symmetry_valid", "element_set_match", "formula_match")
    return done.select("catalog_row_id", "geometry_ok", "valid_structure", "condition_valid", "stoichiometry_valid")


def relaxation_states(spark, d):
    diverged, converged = quality.relaxation_state(F.col("relax_final_energy_ev"), F.col("relax_final_fmax"))
    per_atom = F.col("relax_final_energy_ev") / F.nullif(F.col("atom_count"), F.lit(0))
    return table(spark, d, "structure_catalog").select("catalog_row_id", diverged.alias("diverged"), converged.alias("converged"), per_atom.alias("energy_per_atom"))


def lenient_parse(spark, d):
    n = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select(
        "event_id", lenient_bool(n).alias("as_flag"), switch_bool(n).alias("as_switch"), lenient_float(n).alias("as_float"), lenient_int(n).alias("as_int")
    )


_SUMS = ",\n".join(f"count(*) FILTER ({f}) AS {f}_count, round(count(*) FILTER ({f}) / count(*), 6) AS {f}_rate" for f in FLAGS)

QUERIES = {f.__name__: f for f in (group_quality_rates, catalog_flag_summary, catalog_group_rates, classification_histogram, flag_cascade, relaxation_states, lenient_parse)}

ORACLE = {
    "group_quality_rates": """
SELECT coalesce(CAST(l_returnflag AS VARCHAR), 'None') AS returnflag, count(*) AS total,
  count(*) FILTER (l_quantity >= 25) AS large_count, round(count(*) FILTER (l_quantity >= 25) / count(*), 6) AS large_rate,
  count(*) FILTER (l_discount > 0.05) AS discounted_count, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS discounted_rate,
  count(*) FILTER (l_tax > 0.04 AND l_tax <> 0) AS taxed_count, round(count(*) FILTER (l_tax > 0.04 AND l_tax <> 0) / count(*), 6) AS taxed_rate,
  count(*) FILTER (l_linestatus = 'F') AS filled_count, round(count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS filled_rate
FROM lineitem GROUP BY 1""",
    "catalog_flag_summary": f"SELECT count(*) AS total, {_SUMS} FROM structure_catalog",
    "catalog_group_rates": f"SELECT coalesce(CAST(target_spacegroup AS VARCHAR), 'None') AS spacegroup, count(*) AS total, {_SUMS} FROM structure_catalog GROUP BY 1",
    "classification_histogram": """
SELECT CASE WHEN NOT coalesce(parse_valid, false) THEN 'parse_failed' WHEN NOT coalesce(symmetry_valid, false) THEN 'symmetry_failed'
  WHEN NOT coalesce(geometry_valid, false) THEN 'invalid_geometry' WHEN NOT coalesce(element_set_match, true) THEN 'composition_changed'
  WHEN target_spacegroup_match THEN 'target_spacegroup_retained' ELSE 'symmetry_changed' END AS class, count(*) AS records
FROM structure_catalog GROUP BY 1""",
    "flag_cascade": """
WITH g AS (SELECT *, coalesce(isfinite(volume_per_atom * atom_count) AND isfinite(min_distance_angstrom) AND volume_per_atom * atom_count > 0
    AND min_distance_angstrom >= 0.6 AND volume_per_atom BETWEEN 1 AND 500, false) AS geometry_ok FROM structure_catalog),
v AS (SELECT *, coalesce(parse_valid, false) AND geometry_ok AND coalesce(symmetry_valid, false) AS v FROM g)
SELECT catalog_row_id, geometry_ok, v AS valid_structure, v AND coalesce(element_set_match, true) AS condition_valid,
  v AND coalesce(element_set_match, true) AND coalesce(formula_match, true) AS stoichiometry_valid FROM v""",
    "relaxation_states": """
WITH d AS (SELECT *, CASE WHEN relax_final_energy_ev IS NOT NULL AND relax_final_fmax IS NOT NULL THEN
    NOT isfinite(relax_final_energy_ev) OR abs(relax_final_energy_ev) >= 1e6 OR NOT isfinite(relax_final_fmax) OR abs(relax_final_fmax) >= 1e5 END AS diverged FROM structure_catalog)
SELECT catalog_row_id, diverged, NOT diverged AND relax_final_fmax <= 0.1 AS converged, relax_final_energy_ev / nullif(atom_count, 0) AS energy_per_atom FROM d""",
    "lenient_parse": """
WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS n FROM events)
SELECT event_id, CASE WHEN lower(trim(n)) IN ('true','1','yes','y') THEN true WHEN lower(trim(n)) IN ('false','0','no','n') THEN false END AS as_flag,
  coalesce(upper(trim(n)) IN ('T','TRUE','1','YES'), false) AS as_switch, TRY_CAST(nullif(trim(n), '') AS DOUBLE) AS as_float,
  TRY_CAST(trunc(TRY_CAST(nullif(trim(n), '') AS DOUBLE)) AS INTEGER) AS as_int FROM k""",
}
