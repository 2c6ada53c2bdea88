"""Logs and reports, written from table columns and read back, and nested reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import reports
from tabulon.session import table


def job_logs(spark, d):
    """Logs of results: two energies each, of which the last counts, and the signs of completion."""
    dft = table(spark, d, "dft_materials")
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    log = F.concat(
        F.lit(" NIONS =  "), F.col("atom_count").cast("string"), F.lit("\n  free  energy   TOTEN  =   -1.5 eV\n  free  energy   TOTEN  =   "), e("relax_energy_per_atom_ev"), F.lit(" eV\n energy(sigma->0) =  "), e("static_soc_energy_per_atom_ev"),
        F.when(F.col("relax_converged"), "\n reached required accuracy").otherwise(""), F.when(F.col("relax_completed"), "\n General timing and accounting informations for this job").otherwise(""), F.lit("\n aborting loop because EDIFF is reached"),
    )
    rows = dft.select("dft_row_id", log.alias("log"), F.when(F.col("relax_job_count") > 0, "relax").otherwise("band_soc").alias("stage"))
    out = reports.job_logs(rows, "log", F.col("stage"))
    return out.select("dft_row_id", "atoms", F.round("total_energy", 6).alias("total_energy"), F.round("energy_per_atom", 12).alias("energy_per_atom"), "complete", "electronic_converged", "ionic_converged")


def band_reports(spark, d):
    """Orders as band reports: a point each line item, degenerate as often as its line number says."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_returnflag").alias("f"))
    block = F.concat(F.lit("knum = "), F.col("l_linenumber"), F.lit(" kname= K"), F.col("l_linenumber"), F.lit("\nk = 0.0 0.5 1.25\nbnd ndg eigval\n "), F.col("q"), F.lit(" "), F.col("l_linenumber"), F.lit(" -"), F.col("q"), F.lit(".25 = "), F.col("f"), F.lit("\nnote\n\n 9 9 9.9 = lost\n"))
    text = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b")))), lambda s: s["b"]), "").alias("text"))
    out = reports.band_report(text, "l_orderkey", "text")
    return out.select("l_orderkey", "knum", "kname", F.col("k")[2].alias("kz"), "bnd", "eigval", "irrep")


def species_pages(spark, d):
    """Parts as pages of species tables with lines that go on."""
    s = F.col("p_size")
    text = F.concat(F.lit("note 5\nThe essential degeneracies of\nDNL net "), s, F.lit("-"), s + 1, F.lit(",\n 7, "), s + 3, F.lit("\nother\nDNL "), s, F.lit("\nThe accidental  degeneracies\n 12\nTP 5–6"))
    out = reports.species_tables(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t", ["DNL", "DNL net", "TP"])
    return out.select("p_partkey", "section", "species", "expression")


def _books(spark, d):
    s = F.col("p_size")
    first = F.concat(F.lit("SG "), s, F.lit("\nA; GX;\n DP and P-DNLs here\nB1; XM; TP\n"))
    second = F.concat(F.lit("more DP\nSG 999\nC; LL; DP\nSG "), s + 1, F.lit("\nD; GA; P-DNL"))
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(7).alias("page"), first.alias("t")), F.struct(F.lit(8).alias("page"), second.alias("t")))).alias("b")).select("p_partkey", "b.*")


_ALIASES = {"DP": ("DP",), "TP": ("TP",), "P-DNLs": ("DNL", "DNL net"), "P-DNL": ("DNL",)}


def path_listings(spark, d):
    """Parts as books of two pages: a block of a space group goes on over the pages."""
    return reports.path_listing(_books(spark, d), "p_partkey", "page", "t", _ALIASES)


def particle_index(spark, d):
    """The index of each part's species page and book."""
    tables = species_pages(spark, d)
    paths = path_listings(spark, d)
    out = reports.particle_index(tables, paths, "p_partkey")
    return out.select("p_partkey", "spacegroup", "category", F.array_join("particles", ";").alias("particles"))


def band_values(spark, d):
    """Suppliers as XML results of two points and two bands."""
    s = F.col("s_suppkey").cast("string")
    point = lambda k, a, b: F.concat(F.lit(f'<set comment="kpoint {k}"><r>  {a}.'), s, F.lit(f' 1.0 </r> <r> {b}.'), s, F.lit(" 0.0 </r></set>"))
    xml = F.concat(F.lit('<eigenvalues><array><set><set comment="spin 1">'), point(1, -1, 2), point(2, -3, 4), F.lit("</set></set></array></eigenvalues>"))
    out = reports.band_values(table(spark, d, "supplier").select("s_suppkey", xml.alias("x")), "s_suppkey", "x")
    return reports.in_window(out, "energy", F.lit(0.0), 3.5)


def nested_reports(spark, d):
    """Space groups with their analyses and results as one JSON text."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL").groupBy("spacegroup_number", "soc").agg(F.count(F.lit(1)).alias("rows"))
    m = table(spark, d, "dft_materials").where("target_spacegroup IS NOT NULL").groupBy(F.col("target_spacegroup").alias("spacegroup_number")).agg(F.count(F.lit(1)).alias("results"))
    return reports.nested_report({"analyses": t, "materials": m}, "spacegroup_number")


QUERIES = {f.__name__: f for f in (job_logs, band_reports, species_pages, path_listings, particle_index, band_values, nested_reports)}

_SPECIES = """
SELECT p_partkey, 'essential' AS section, 'DNL net' AS species, p_size || '-' || (p_size + 1) || ', 7, ' || (p_size + 3) AS expression FROM part UNION ALL SELECT p_partkey, 'essential', 'DNL', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'accidental', 'TP', '5-6' FROM part"""
_PATHS = """
SELECT p_partkey, p_size AS spacegroup, unnest(['DP', 'DNL', 'DNL net']) AS abbreviation, 'A' AS line_label, 'GX' AS path, 7 AS page FROM part UNION ALL SELECT p_partkey, p_size, unnest(['TP', 'DP']), 'B1', 'XM', 7 FROM part UNION ALL SELECT p_partkey, p_size + 1, 'DNL', 'D', 'GA', 8 FROM part"""
ORACLE = {
    "job_logs": """
SELECT dft_row_id, atom_count AS atoms, CASE WHEN relax_energy_per_atom_ev IS NULL OR isnan(relax_energy_per_atom_ev) THEN -1.5 ELSE round(relax_energy_per_atom_ev, 6) END AS total_energy,
  round(CASE WHEN static_soc_energy_per_atom_ev IS NOT NULL AND NOT isnan(static_soc_energy_per_atom_ev) THEN static_soc_energy_per_atom_ev WHEN relax_energy_per_atom_ev IS NULL OR isnan(relax_energy_per_atom_ev) THEN -1.5 ELSE relax_energy_per_atom_ev END / atom_count, 12) AS energy_per_atom,
  coalesce(relax_completed, FALSE) AS complete, TRUE AS electronic_converged, CASE WHEN relax_job_count > 0 THEN coalesce(relax_converged, FALSE) END AS ionic_converged FROM dft_materials""",
    "band_reports": """
WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::INT AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber AS knum, 'K' || l_linenumber AS kname, 1.25 AS kz, q + unnest(generate_series(0, l_linenumber - 1)) AS bnd, -(q + 0.25) AS eigval, f AS irrep FROM b""",
    "species_pages": _SPECIES,
    "path_listings": _PATHS,
    "particle_index": f"""
WITH s AS ({_SPECIES}), p AS ({_PATHS}),
l AS (SELECT p_partkey, section AS category, species AS particle, unnest(CASE WHEN species = 'DNL net' THEN [p_size, p_size + 1, 7, p_size + 3] WHEN species = 'DNL' THEN [p_size] ELSE [5, 6] END) AS spacegroup FROM s JOIN part USING (p_partkey)),
f AS (SELECT DISTINCT p_partkey, 'accidental' AS category, abbreviation AS particle, spacegroup FROM p),
u AS (SELECT DISTINCT *, 0 AS o FROM l UNION ALL SELECT *, 1 FROM (SELECT * FROM f EXCEPT SELECT * FROM l))
SELECT p_partkey, spacegroup, category, string_agg(particle, ';' ORDER BY o, particle) AS particles FROM u GROUP BY 1, 2, 3""",
    "band_values": """
WITH r AS (SELECT s_suppkey, unnest([{'k': 1, 'band': 1, 'e': '-1', 'o': 1.0}, {'k': 1, 'band': 2, 'e': '2', 'o': 0.0}, {'k': 2, 'band': 1, 'e': '-3', 'o': 1.0}, {'k': 2, 'band': 2, 'e': '4', 'o': 0.0}]) AS r FROM supplier),
v AS (SELECT s_suppkey, 1 AS spin, r.k AS k, r.band AS band, (r.e || '.' || s_suppkey)::DOUBLE AS energy, r.o::DOUBLE AS occupation FROM r) SELECT * FROM v WHERE energy BETWEEN -3.5 AND 3.5""",
    "nested_reports": """
WITH t AS (SELECT spacegroup_number AS g, soc, count(*) AS n FROM topology_labels WHERE spacegroup_number IS NOT NULL GROUP BY 1, 2),
a AS (SELECT g, string_agg('{"soc":' || coalesce(soc::VARCHAR, 'null') || ',"rows":' || n || '}', ',' ORDER BY soc NULLS FIRST) AS a FROM t GROUP BY 1), m AS (SELECT target_spacegroup AS g, count(*) AS n FROM dft_materials WHERE target_spacegroup IS NOT NULL GROUP BY 1)
SELECT g AS spacegroup_number, '{"analyses":[' || coalesce(a, '') || '],"materials":[' || coalesce('{"results":' || n || '}', '') || ']}' AS report FROM a FULL JOIN m USING (g)""",
}
