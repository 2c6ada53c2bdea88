"""References to records that do not exist."""

from __future__ import annotations

from tabulon.operators import orphans

QUERIES = {"p3_found": orphans.p3_found, "p3_orphan_counts": orphans.p3_orphan_counts}

_REFS = r"""
WITH written AS (
  SELECT 'dft_materials' AS ref_table, dft_row_id AS ref_row_id, regexp_replace(candidate_id, '^\s+|\s+$', '', 'g') AS v, parsed_at AS moment, coalesce(mapping_status = 'mapped', false) AS claims FROM dft_materials
  UNION ALL
  SELECT 'topology_labels', topology_row_id, regexp_replace(candidate_id, '^\s+|\s+$', '', 'g'), analyzed_at, false FROM topology_labels),
refs AS (
  SELECT ref_table, ref_row_id, moment, CASE WHEN v IN ('', '-', 'None', 'nan') THEN NULL ELSE replace(v, '/', '__') END AS k, claims FROM written),
asked AS (SELECT * FROM refs WHERE k IS NOT NULL OR claims),
lives AS (
  SELECT candidate_id AS k, cataloged_at AS b, deleted_at AS e FROM structure_catalog
  UNION ALL SELECT legacy_id, cataloged_at, deleted_at FROM structure_catalog),
orphans AS (
  SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.k = a.k AND l.b <= a.moment AND (l.e IS NULL OR a.moment < l.e)))
"""

ORACLE = {
    "p3_found": _REFS + "SELECT ref_table, ref_row_id FROM orphans",
    "p3_orphan_counts": _REFS
    + """
, every AS (SELECT ref_table, strftime(moment, '%Y-%m') AS month, count(*) AS refs FROM asked GROUP BY ALL),
bad AS (SELECT ref_table, strftime(moment, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL)
SELECT e.ref_table, e.month, e.refs, coalesce(b.orphans, 0) AS orphans
FROM every e LEFT JOIN bad b ON e.ref_table = b.ref_table AND e.month IS NOT DISTINCT FROM b.month""",
}
