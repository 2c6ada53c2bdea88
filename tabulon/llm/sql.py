"""DuckDB SQL of the queries that SQL can express."""

_VALUE = r"CASE WHEN regexp_replace(candidate_id, '^\s+|\s+$', '', 'g') IN ('', '-', 'None', 'nan') THEN NULL ELSE replace(regexp_replace(candidate_id, '^\s+|\s+$', '', 'g'), '/', '__') END"

_LINKS = """
WITH RECURSIVE p AS (
  SELECT left_candidate_id AS a, right_candidate_id AS b FROM structure_match_pairs WHERE is_match
  UNION SELECT candidate_id, duplicate_of FROM structure_catalog WHERE duplicate_of IS NOT NULL),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
r(id, peer) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.peer = e.a),
g AS (SELECT id AS candidate_id, min(peer) AS group_id FROM r GROUP BY 1)
"""

_SYSTEMS = rf"""
WITH RECURSIVE x AS (
  SELECT oof_row_id, chemical_system AS written, {_VALUE} AS c, list_filter(string_split_regex(chemical_system, '[^A-Za-z]+'), lambda t: t <> '') AS parts FROM particle_dp_oof_predictions),
y AS (SELECT *, CASE WHEN len(parts) <> 1 OR regexp_full_match(parts[1], '[a-z]{{1,2}}') THEN parts ELSE regexp_extract_all(parts[1], '[A-Z][a-z]?') END AS symbols FROM x),
z AS (SELECT oof_row_id, written, c, nullif(array_to_string(list_sort(list_distinct(list_transform(symbols, lambda t: upper(t[1]) || lower(t[2:])))), '-'), '') AS s FROM y),
e AS (SELECT DISTINCT 's' || s AS a, 'c' || c AS b FROM z WHERE s IS NOT NULL AND c IS NOT NULL),
w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, peer) AS (SELECT n, n FROM (SELECT 's' || s AS n FROM z WHERE s IS NOT NULL UNION SELECT 'c' || c FROM z WHERE c IS NOT NULL) UNION SELECT r.id, w.b FROM r JOIN w ON r.peer = w.a),
k AS (SELECT id, min(peer) AS low, min(peer) FILTER (peer LIKE 's%') AS sys FROM r GROUP BY 1),
rows AS (SELECT z.oof_row_id, z.written, k.low, k.sys FROM z JOIN k ON k.id = coalesce('s' || z.s, 'c' || z.c)),
m AS (SELECT low FROM rows GROUP BY 1 HAVING count(DISTINCT written) > 1)
SELECT oof_row_id, substr(sys, 2) AS group_key FROM rows WHERE low IN (SELECT low FROM m)
"""

_COLUMNS = {
    "text": "result_name candidate_id mapping_status mapping_method reduced_formula final_structure_file primary_band_job_directory relax_completed relax_converged static_soc_completed band_soc_completed irvsp_completed band_symmetry_consistent target_spacegroup_retained_strict symmetry_tolerance_sensitive low_energy_polymorph dft_row_id workflow_run_count relax_job_count band_job_count target_spacegroup dft_spacegroup_hint relaxed_spacegroup_strict relaxed_spacegroup_standard atom_count parsed_at loaded_at".split(),
    "real": "relax_energy_per_atom_ev static_soc_energy_per_atom_ev relative_energy_per_atom_ev".split(),
}
_FILLED = " + ".join([f"({c} IS NOT NULL)::INT" for c in _COLUMNS["text"]] + [f"({c} IS NOT NULL AND NOT isnan({c}))::INT" for c in _COLUMNS["real"]])

_GROUPED = f"""
WITH v AS (SELECT *, {_FILLED} AS filled, {_VALUE} AS k FROM dft_materials),
l AS (SELECT legacy_id, min(candidate_id) AS c FROM structure_catalog WHERE legacy_id NOT IN (SELECT candidate_id FROM structure_catalog) GROUP BY 1 HAVING count(DISTINCT candidate_id) = 1),
g AS (SELECT v.*, coalesce(l.c, k) AS whole, EXISTS (SELECT 1 FROM topology_labels t WHERE t.result_name = v.result_name AND t.analysis_completed) AS done FROM v LEFT JOIN l ON l.legacy_id = k WHERE k IS NOT NULL)"""

_SURVIVORS = f"""{_GROUPED},
r AS (SELECT whole, dft_row_id, row_number() OVER (PARTITION BY whole ORDER BY done DESC, filled DESC, parsed_at DESC NULLS LAST, dft_row_id) AS n, count(*) OVER (PARTITION BY whole) AS m FROM g)
SELECT whole AS candidate_id, dft_row_id FROM r WHERE n = 1 AND m > 1
"""

_RECORD = [c for c in _COLUMNS["text"] if c not in ("candidate_id", "dft_row_id")]
_FILLED_BY_GROUP = (
    _GROUPED + ", w AS (SELECT whole, count(*) AS m, " + ", ".join([f"max({c}::VARCHAR) AS {c}" for c in _RECORD] + [f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {c}" for c in _COLUMNS["real"]])
    + " FROM g GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, sum(m)::BIGINT AS rows, " + ", ".join(f"count({c}) AS {c}" for c in [*_RECORD, *_COLUMNS["real"]]) + " FROM w"
)


def _composition(name: str, source: str) -> str:
    """CTEs giving (text, key) of every formula text of ``source``."""
    return rf"""
{name}_t AS (SELECT DISTINCT f, regexp_replace(translate(f, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '\s+', '', 'g') AS t FROM {source} WHERE f IS NOT NULL),
{name}_e AS (SELECT f, unnest(regexp_extract_all(t, '([A-Z][a-z]?)(\d*)', 1)) AS e, unnest(regexp_extract_all(t, '([A-Z][a-z]?)(\d*)', 2)) AS n FROM {name}_t WHERE regexp_full_match(t, '([A-Z][a-z]?\d{{0,4}})+')),
{name}_s AS (SELECT f, e, sum(CASE WHEN n = '' THEN 1 ELSE n::INT END)::INT AS n FROM {name}_e GROUP BY 1, 2),
{name}_g AS (SELECT f, list_reduce(list(n), lambda a, b: gcd(a, b)::INT) AS g FROM {name}_s GROUP BY 1),
{name} AS (SELECT s.f, string_agg(e || (n // g), '-' ORDER BY e) AS k FROM {name}_s s JOIN {name}_g g USING (f) GROUP BY 1)"""


_LINKED = (
    rf"""
WITH q AS (
  SELECT dft_row_id, relax_energy_per_atom_ev AS energy, translate(result_name, '₀₁₂₃₄₅₆₇₈₉', '0123456789') AS name, reduced_formula FROM dft_materials
  WHERE {_VALUE} IS NULL AND mapping_status IS DISTINCT FROM 'mapped'),
b AS (SELECT *, regexp_replace(regexp_replace(name, '(?i)sg[-_ ]?\d+', '~', 'g'), '(^|[^A-Za-z0-9])[PIFCRA]\d_\d([^0-9]|$)', '\1~\2', 'g') AS bare FROM q),
n AS (SELECT *, regexp_extract_all(regexp_replace(bare, '([^A-Za-z0-9])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9])(?:no|n)?(\d+)(?:[^A-Za-z0-9]|$)', 1) AS numbers,
  list_filter(string_split_regex(name, '[^A-Za-z0-9]+'), lambda p: regexp_full_match(p, '([A-Z][a-z]?\d*){{2,}}') AND p NOT LIKE 'SG%')[1] AS token FROM b),
d AS (SELECT dft_row_id, energy, coalesce(reduced_formula, token) AS f, ltrim(list_filter(numbers, lambda n: len(n) = list_max(list_transform(numbers, lambda m: len(m))))[1], '0') AS number FROM n),
c AS (SELECT DISTINCT candidate_id, coalesce(reduced_formula, actual_formula, target_formula, regexp_extract(legacy_id, '^([A-Za-z0-9]+)_', 1)) AS f, ltrim(regexp_extract(legacy_id, '(\d+)$', 1), '0') AS number, relax_energy_per_atom_ev AS energy FROM structure_catalog),"""
    + _composition("dk", "d")
    + ","
    + _composition("ck", "c")
    + """,
m AS (SELECT DISTINCT d.dft_row_id, c.candidate_id FROM d JOIN dk ON d.f = dk.f JOIN ck ON ck.k = dk.k JOIN c ON c.f = ck.f
  WHERE CASE WHEN d.number IS NOT NULL THEN c.number = d.number ELSE abs(c.energy - d.energy) <= 0.01 END)
SELECT dft_row_id, min(candidate_id) AS candidate_id FROM m GROUP BY 1 HAVING count(*) = 1"""
)

ORACLE: dict[str, str] = {
    "p1_invariants": "SELECT unnest(['train', 'validation', 'test']) AS split, TRUE AS share_met, 0::BIGINT AS torn",
    "p4_filled": _FILLED_BY_GROUP,
    "p7_invariants": "SELECT window_name, capacity_tokens AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS cut_small, 0::BIGINT AS gaps, 0::BIGINT AS over_limit FROM context_windows",
    "p8_invariants": "SELECT source, TRUE AS share_met, 0::BIGINT AS over_repeats, 0::BIGINT AS strangers FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
    "p1_found": _SYSTEMS,
    "p4_found": _SURVIVORS,
    "p5_found": _LINKED,
    "p6_found": _LINKS + "SELECT * FROM g",
    "p6_group_sizes": _LINKS + "SELECT members, count(*) AS groups FROM (SELECT group_id, count(*) AS members FROM g GROUP BY 1) GROUP BY 1",
}
