"""Texts, names, series and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import formulas, text
from tabulon.operators import lookup, series
from tabulon.session import table
from tabulon.workspace import Workspace


def token_counts(spark, d):
    t = table(spark, d, "topology_labels").select("result_name", F.explode(text.tokens(F.col("compatible_particles"))).alias("particle"))
    return t.groupBy("particle").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("result_name").alias("results"))


def distinct_set_string(spark, d):
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL")
    t = t.select("spacegroup_number", F.explode_outer(text.tokens(F.col("high_symmetry_paths"))).alias("path"))
    return t.groupBy("spacegroup_number").agg(F.array_join(F.array_sort(F.collect_set("path")), ";").alias("paths"))


def name_fields(spark, d):
    """Fields of generated names, and the id and file name made of them."""
    cat = table(spark, d, "structure_catalog")
    pattern = r"^(.+)_sg(\d+)_(\d+)$"
    part = lambda g: F.regexp_extract("legacy_id", pattern, g)
    return cat.select(
        "catalog_row_id", F.nullif(part(1), F.lit("")).alias("formula"), part(2).try_cast("int").alias("spacegroup"), part(3).try_cast("int").alias("number"),
        F.concat_ws("__", "source_collection", "legacy_id").alias("built_id"), F.concat(F.regexp_replace(part(1), "[^A-Za-z0-9]+", "_"), F.lit("_sg"), F.lpad(part(2), 3, "0")).alias("stem"),
        F.element_at(F.split("source_file", "/"), -2).alias("folder"), F.substring_index("source_file", ".", -1).alias("suffix"),
    )


def formula_keys(spark, d):
    return table(spark, d, "structure_catalog").select("catalog_row_id", formulas.composition(F.col("reduced_formula")).alias("composition"), F.size(text.expanded_atoms(F.col("target_formula"))).alias("atoms"), F.array_join(text.expanded_atoms(F.col("target_formula")), "").alias("expanded"))


def system_keys(spark, d):
    return table(spark, d, "particle_dp_oof_predictions").select("oof_row_id", formulas.chemical_system(F.regexp_replace("chemical_system", "[^A-Za-z]+", "-")).alias("system")).where("system IS NOT NULL").groupBy("system").agg(F.count(F.lit(1)).alias("rows"))


def range_expand(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + 2, F.lit(", "), F.col("p_size") + 1, F.lit(",x")).alias("text"))
    return p.select("p_partkey", F.explode(text.expand_ranges(F.col("text"))).alias("value"))


def settings_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("nsw = 1 ! first\n# note\nISYM="), F.col("p_size"), F.lit("\nNSW = "), F.col("p_size") * 2, F.lit(" # last")).alias("t"))
    s = p.select("p_partkey", text.settings(F.col("t")).alias("s"))
    nsw, isym = F.col("s")["NSW"].try_cast("int"), F.col("s")["ISYM"].try_cast("int")
    return s.select("p_partkey", nsw.alias("nsw"), isym.alias("isym"), F.when(nsw > 50, "relax").when(isym == 2, "one_step_symmetry").otherwise("static_nosoc").alias("stage"))


def fuzzy_name_rank(spark, d):
    """The best matching result of each query name, and whether it is the only best."""
    names = table(spark, d, "dft_materials").where("result_name IS NOT NULL").select("result_name").distinct()
    asked = table(spark, d, "topology_labels").where("result_name IS NOT NULL AND topology_row_id % 50 = 0").select("topology_row_id", F.regexp_replace("result_name", r"_\d+$", "").alias("query"))
    scored = lookup.named_like(Workspace(spark, "names"), names, "result_name", asked, "topology_row_id", "query")
    return lookup.best_named(scored, "topology_row_id", "query", "result_name").select("topology_row_id", "query", "score", "ties")


def regex_audit(spark, d):
    """Texts with addresses of mail or paths of machines, with the first hit."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    mail, path = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", r"@node[0-9]+:/[A-Za-z0-9_/]+"
    hit = docs.select("doc_id", F.regexp_extract("text", mail, 0).alias("mail"), F.regexp_extract("text", path, 0).alias("machine"))
    return hit.where("mail != '' OR machine != ''")


_REQUIRED = [["spin-orbit", "soc"], ["crossing", "gap"], ["symmetry"]]


def concept_scoring(spark, d):
    docs = table(spark, d, "documents")
    t = F.col("text")
    done = docs.select("doc_id", F.round(text.concept_score(t, _REQUIRED), 6).alias("score"), F.array_join(text.missing_groups(t, _REQUIRED), ";").alias("missing"), F.array_join(text.forbidden_hits(t, ["proves", "stable"]), ";").alias("forbidden"))
    return done.withColumn("passed", (F.col("score") == 1) & (F.col("forbidden") == ""))


def relax_log_state(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return series.last_log_step(series.lines_of(docs, "doc_id", "text"), "doc_id")


def section_carry_forward(spark, d):
    """Lines of texts by the speaker whose turn they are in; other texts have none."""
    lines = series.lines_of(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    header = F.nullif(F.regexp_extract("line", r"^(User|Agent): ", 1), F.lit(""))
    done = series.carry_forward(lines, ["doc_id"], "line_no", header, "speaker")
    return done.groupBy("doc_id", F.coalesce("speaker", F.lit("none")).alias("speaker")).agg(F.count(F.lit(1)).alias("lines"))


def degenerate_expand(spark, d):
    """Each line item repeated as often as its line number says, with running indices."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return li.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(0), F.col("l_linenumber") - 1)).alias("step")).withColumn("band", F.col("l_linenumber") + F.col("step"))


def local_minimum_events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return series.local_minima(e, ["user_id"], ["ts", "event_id"], "value", 60.0).select("event_id", "user_id", "value", "previous", "next")


def label_exchange_events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("lo"), F.when(F.col("event_id") % 2 == 0, "view").otherwise("click").alias("hi"))
    return series.label_exchanges(e, ["user_id"], ["ts", "event_id"], "lo", "hi").select("event_id", "user_id")


def adjacent_pairs(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return series.adjacent_pairs(li, ["l_orderkey"], "l_linenumber", "l_quantity")


def interval_join_first(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders")
    day = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")
    spans = o.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.struct(day(a).alias("a"), day(b).alias("b"), F.lit(i).alias("ord"), F.lit(n).alias("span")) for i, (a, b, n) in enumerate([(0, 30, "early"), (30, 60, "middle"), (60, 400, "late")])])).alias("s")).select("l_orderkey", "s.*")
    return series.interval_first(li, spans, ["l_orderkey"], "l_shipdate", "a", "b", "ord", "span").select("l_orderkey", "l_linenumber", "span")


def asof_status(spark, d):
    """Each result with the analysis flag of its latest topology row at loading time."""
    left = table(spark, d, "dft_materials").where("result_name IS NOT NULL").select("dft_row_id", "result_name", F.col("loaded_at").alias("at"))
    right = table(spark, d, "topology_labels").where("result_name IS NOT NULL").groupBy("result_name", F.col("analyzed_at").alias("at")).agg(F.max("topology_row_id").alias("topology_row_id"))
    return series.asof_backward(left, right, ["result_name"], "at", "topology_row_id", "topology_row_id").select("dft_row_id", "topology_row_id")


def path_matches(spark, d):
    """Paths of analyses matched, in either direction, to the paths of analyses with one confirmed particle."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL")
    known = t.where("confirmed_particles != '' AND NOT contains(confirmed_particles, ';')").select("spacegroup_number", F.explode(text.tokens(F.col("high_symmetry_paths"))).alias("known"), F.col("confirmed_particles").alias("particle"))
    seen = t.select("topology_row_id", "spacegroup_number", F.explode(text.tokens(F.col("high_symmetry_paths"))).alias("path"))
    done = lookup.match_paths(seen, known, ["spacegroup_number"], "path", "known", "particle")
    return done.select("topology_row_id", "path", "path_status", F.array_join("candidates", ";").alias("candidates"))


def compared_paths(spark, d):
    """Paths of each space group's analyses with their crossings, beside the entries of analyses with one confirmed particle."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL")
    entries = t.where("confirmed_particles != '' AND NOT contains(confirmed_particles, ';')").select("spacegroup_number", F.explode(text.tokens(F.col("high_symmetry_paths"))).alias("path"), F.col("confirmed_particles").alias("particle"), F.lit("l").alias("line_label"), F.lit(1).alias("page"))
    summaries = t.select("spacegroup_number", F.explode(text.tokens(F.col("high_symmetry_paths"))).alias("path"), F.coalesce("crossing_count", F.lit(0)).alias("n")).groupBy("spacegroup_number", "path").agg(F.sum("n").alias("crossings"))
    return lookup.compared(summaries, entries, ["spacegroup_number"], "path", "particle").select("spacegroup_number", "path", "crossings", "particle", "classification")


def lookup_expand(spark, d):
    """Ordered particle entries of each space group: confirmed ones first, then compatible ones."""
    t = table(spark, d, "topology_labels").where("spacegroup_number IS NOT NULL").select("spacegroup_number", "topology_row_id", "confirmed_particles", "compatible_particles")
    part = lambda c, o, p: t.select("spacegroup_number", F.lit(o).alias("category_ord"), F.posexplode(text.tokens(F.col(c))).alias("pos", "particle"), "topology_row_id", F.lit(p).alias("has"))
    both = part("confirmed_particles", 0, 0).unionByName(part("compatible_particles", 1, 1))
    entries = both.groupBy("spacegroup_number", "category_ord", "particle").agg(F.min(F.col("topology_row_id") * 100 + F.col("pos")).alias("ord"), F.max("has").alias("has"))
    entries = entries.withColumn("paths", F.when(F.col("has") == 1, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")))
    keys = t.select("spacegroup_number").distinct()
    return lookup.lookup(keys, entries, ["spacegroup_number"], "particle").select("spacegroup_number", F.array_join("entries", ";").alias("particles"))


def evidence_ladder(spark, d):
    """Per material the level of evidence and what limits it."""
    t = table(spark, d, "topology_labels").where("result_name IS NOT NULL").groupBy("result_name").agg(F.sum(F.coalesce("crossing_count", F.lit(0))).alias("n"), F.count_if("strict_topology_hit").alias("strict"), F.bool_and(F.coalesce("soc", F.lit(False))).alias("soc"), F.bool_or(F.coalesce("analysis_completed", F.lit(False))).alias("done"))
    notes = lookup.limitations([(~F.col("done"), "analysis failed"), (~F.col("soc"), "no spin-orbit coupling"), (F.col("n") == 0, "no crossing")])
    return t.select("result_name", lookup.evidence_level(F.col("n"), F.col("strict")).alias("level"), F.array_join(notes, "; ").alias("limitations"))


def crossing_diagnostics(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 1000).alias("gap"), ((F.col("event_id") % 21 - 10) / 10).alias("energy"))
    return e.select("event_id", lookup.gap_class(F.col("gap"), 0.05).alias("gap_class"), lookup.energy_class(F.col("energy")).alias("energy_class"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, distinct_set_string, name_fields, formula_keys, system_keys, range_expand, settings_parse, fuzzy_name_rank, regex_audit, concept_scoring, relax_log_state, section_carry_forward, degenerate_expand, local_minimum_events, label_exchange_events, adjacent_pairs, interval_join_first, asof_status, path_matches, compared_paths, lookup_expand, evidence_ladder, crossing_diagnostics)
}

_LIKE = lambda p: f"contains(lower(coalesce(text, '')), '{p}')"
ORACLE = {
    "token_counts": """
WITH x AS (SELECT result_name, trim(unnest(string_split(compatible_particles, ';'))) AS particle FROM topology_labels)
SELECT particle, count(*) AS mentions, count(DISTINCT result_name) AS results FROM x WHERE particle <> '' GROUP BY 1""",
    "system_keys": """
WITH x AS (SELECT oof_row_id, list_filter(string_split_regex(chemical_system, '[^A-Za-z]+'), lambda t: t <> '') AS parts FROM particle_dp_oof_predictions),
y AS (SELECT CASE WHEN len(parts) <> 1 OR regexp_full_match(parts[1], '[a-z]{1,2}') THEN parts ELSE regexp_extract_all(parts[1], '[A-Z][a-z]?') END AS symbols FROM x),
z AS (SELECT nullif(array_to_string(list_sort(list_distinct(list_transform(symbols, lambda t: upper(t[1]) || lower(t[2:])))), '-'), '') AS system FROM y)
SELECT system, count(*) AS rows FROM z WHERE system IS NOT NULL GROUP BY 1""",
    "distinct_set_string": """
WITH x AS (SELECT spacegroup_number, trim(unnest(string_split(high_symmetry_paths, ';'))) AS path FROM topology_labels WHERE spacegroup_number IS NOT NULL),
k AS (SELECT DISTINCT spacegroup_number FROM topology_labels WHERE spacegroup_number IS NOT NULL),
s AS (SELECT DISTINCT spacegroup_number, path FROM x WHERE path <> '')
SELECT k.spacegroup_number, coalesce(string_agg(path, ';' ORDER BY path), '') AS paths FROM k LEFT JOIN s ON k.spacegroup_number = s.spacegroup_number GROUP BY 1""",
    "name_fields": r"""
WITH x AS (SELECT *, regexp_extract(legacy_id, '^(.+)_sg(\d+)_(\d+)$', 1) AS a, regexp_extract(legacy_id, '^(.+)_sg(\d+)_(\d+)$', 2) AS b, regexp_extract(legacy_id, '^(.+)_sg(\d+)_(\d+)$', 3) AS c FROM structure_catalog)
SELECT catalog_row_id, nullif(a, '') AS formula, TRY_CAST(b AS INTEGER) AS spacegroup, TRY_CAST(c AS INTEGER) AS number, source_collection || '__' || legacy_id AS built_id,
  regexp_replace(a, '[^A-Za-z0-9]+', '_', 'g') || '_sg' || lpad(b, 3, '0') AS stem, string_split(source_file, '/')[-2] AS folder, string_split(source_file, '.')[-1] AS suffix FROM x""",
    "formula_keys": r"""
WITH x AS (SELECT catalog_row_id, regexp_replace(translate(reduced_formula, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '\s+', '', 'g') AS f, regexp_replace(target_formula, '\s+', '', 'g') AS t FROM structure_catalog),
e AS (SELECT catalog_row_id, unnest(regexp_extract_all(f, '([A-Z][a-z]?)(\d*)', 1)) AS e, unnest(regexp_extract_all(f, '([A-Z][a-z]?)(\d*)', 2)) AS n FROM x WHERE regexp_full_match(f, '([A-Z][a-z]?\d{0,4})+')),
s AS (SELECT catalog_row_id, e, sum(CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END)::INTEGER AS n FROM e GROUP BY 1, 2),
g AS (SELECT catalog_row_id, list_reduce(list(n), lambda a, b: gcd(a, b)::INTEGER) AS g FROM s GROUP BY 1),
c AS (SELECT s.catalog_row_id, string_agg(e || (n // g), '-' ORDER BY e) AS composition FROM s JOIN g USING (catalog_row_id) GROUP BY 1),
a AS (SELECT catalog_row_id, unnest(regexp_extract_all(t, '([A-Z][a-z]?)(\d*)', 1)) AS e, unnest(regexp_extract_all(t, '([A-Z][a-z]?)(\d*)', 2)) AS n, unnest(range(len(regexp_extract_all(t, '([A-Z][a-z]?)(\d*)', 1)))) AS i FROM x),
b AS (SELECT catalog_row_id, sum(CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END)::INTEGER AS atoms, string_agg(repeat(e, CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END), '' ORDER BY i) AS expanded FROM a GROUP BY 1)
SELECT x.catalog_row_id, composition, atoms, expanded FROM x LEFT JOIN c USING (catalog_row_id) LEFT JOIN b USING (catalog_row_id)""",
    "range_expand": "SELECT p_partkey, unnest([p_size, p_size + 1, p_size + 2]) AS value FROM part",
    "settings_parse": "SELECT p_partkey, p_size * 2 AS nsw, p_size AS isym, CASE WHEN p_size * 2 > 50 THEN 'relax' WHEN p_size = 2 THEN 'one_step_symmetry' ELSE 'static_nosoc' END AS stage FROM part",
    "fuzzy_name_rank": r"""
WITH n AS (SELECT DISTINCT result_name AS r, regexp_replace(lower(result_name), '[^a-z0-9]+', '', 'g') AS p FROM dft_materials WHERE result_name IS NOT NULL),
q AS (SELECT topology_row_id, regexp_replace(result_name, '_\d+$', '') AS query FROM topology_labels WHERE result_name IS NOT NULL AND topology_row_id % 50 = 0),
k AS (SELECT *, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') AS qp FROM q),
s AS (SELECT topology_row_id, query, CASE WHEN qp = '' THEN NULL WHEN p = qp THEN 100 WHEN starts_with(p, qp) THEN 80 WHEN contains(p, qp) THEN 60 END AS score FROM k JOIN n ON k.qp <> '' AND contains(n.p, k.qp)),
b AS (SELECT topology_row_id, max(score) AS m FROM s WHERE score IS NOT NULL GROUP BY 1)
SELECT s.topology_row_id, query, score, count(*) AS ties FROM s JOIN b ON s.topology_row_id = b.topology_row_id AND s.score = b.m GROUP BY 1, 2, 3""",
    "regex_audit": r"""
WITH h AS (SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+') AS mail, regexp_extract(text, '@node[0-9]+:/[A-Za-z0-9_/]+') AS machine FROM documents WHERE text IS NOT NULL)
SELECT * FROM h WHERE mail <> '' OR machine <> ''""",
    "concept_scoring": f"""
WITH h AS (SELECT doc_id, {_LIKE('spin-orbit')} OR {_LIKE('soc')} AS a, {_LIKE('crossing')} OR {_LIKE('gap')} AS b, {_LIKE('symmetry')} AS c, {_LIKE('proves')} AS x, {_LIKE('stable')} AS y FROM documents)
SELECT doc_id, round((a::INT + b::INT + c::INT) / 3, 6) AS score, concat_ws(';', CASE WHEN NOT a THEN 'spin-orbit' END, CASE WHEN NOT b THEN 'crossing' END, CASE WHEN NOT c THEN 'symmetry' END) AS missing,
  concat_ws(';', CASE WHEN x THEN 'proves' END, CASE WHEN y THEN 'stable' END) AS forbidden, a AND b AND c AND NOT x AND NOT y AS passed FROM h""",
    "relax_log_state": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, n, regexp_extract(line, '^\s*(FIRE|BFGS|LBFGS):?\s+(\d+)\s+(\d\d:\d\d:\d\d)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)\*?\s+(-?[\d.]+(?:[eE][+-]?\d+)?)', ['o', 's', 't', 'e', 'f']) AS g FROM l
  WHERE regexp_matches(line, '^\s*(FIRE|BFGS|LBFGS):?\s+(\d+)\s+(\d\d:\d\d:\d\d)\s+(-?[\d.]+(?:[eE][+-]?\d+)?)\*?\s+(-?[\d.]+(?:[eE][+-]?\d+)?)')),
b AS (SELECT doc_id, max_by(g, n) AS g, count(*) AS log_lines FROM m GROUP BY 1)
SELECT doc_id, log_lines, g.o AS optimiser, CAST(g.s AS INTEGER) AS step, TRY_CAST(g.e AS DOUBLE) AS energy, TRY_CAST(g.f AS DOUBLE) AS fmax, TRY_CAST(g.f AS DOUBLE) <= 0.1 AS converged FROM b""",
    "section_carry_forward": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, nullif(regexp_extract(line, '^(User|Agent): ', 1), '') AS h FROM l),
c AS (SELECT doc_id, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM h)
SELECT doc_id, coalesce(s, 'none') AS speaker, count(*) AS lines FROM c GROUP BY 1, 2""",
    "degenerate_expand": "SELECT l_orderkey, l_linenumber, CAST(s AS INTEGER) AS step, CAST(l_linenumber + s AS INTEGER) AS band FROM lineitem, unnest(range(l_linenumber)) AS u(s)",
    "local_minimum_events": """
SELECT event_id, user_id, value, previous, next FROM (SELECT *, lag(value) OVER w AS previous, lead(value) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE value <= previous AND value < next AND value < 60""",
    "label_exchange_events": """
WITH e AS (SELECT event_id, user_id, ts, event_type AS lo, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS hi FROM events),
w AS (SELECT *, lag(lo) OVER w AS pl, lead(lo) OVER w AS nl, lag(hi) OVER w AS ph, lead(hi) OVER w AS nh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id FROM w WHERE pl = nh AND ph = nl AND pl <> ph""",
    "adjacent_pairs": """
SELECT l_orderkey, l_linenumber, l_quantity, nv AS next_value, abs(nv - l_quantity) AS gap FROM (SELECT l_orderkey, l_linenumber, l_quantity, lead(l_linenumber) OVER w AS ni, lead(l_quantity) OVER w AS nv
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE ni = l_linenumber + 1""",
    "interval_join_first": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY THEN 'early' WHEN l_shipdate BETWEEN o_orderdate + INTERVAL 30 DAY AND o_orderdate + INTERVAL 60 DAY THEN 'middle'
  WHEN l_shipdate BETWEEN o_orderdate + INTERVAL 60 DAY AND o_orderdate + INTERVAL 400 DAY THEN 'late' END AS span FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "asof_status": """
WITH r AS (SELECT result_name, analyzed_at AS at, max(topology_row_id) AS topology_row_id FROM topology_labels WHERE result_name IS NOT NULL AND analyzed_at IS NOT NULL GROUP BY 1, 2)
SELECT dft_row_id, r.topology_row_id FROM (SELECT * FROM dft_materials WHERE result_name IS NOT NULL) d ASOF LEFT JOIN r ON d.result_name = r.result_name AND d.loaded_at >= r.at""",
    "path_matches": """
WITH t AS (SELECT * FROM topology_labels WHERE spacegroup_number IS NOT NULL),
o AS (SELECT topology_row_id, spacegroup_number AS g, trim(unnest(string_split(high_symmetry_paths, ';'))) AS path FROM t),
p AS (SELECT *, upper(regexp_replace(path, '[^\\p{L}]+', '', 'g')) AS c FROM o WHERE path <> ''),
k AS (SELECT DISTINCT g, c, particle FROM (SELECT t.spacegroup_number AS g, confirmed_particles AS particle, upper(regexp_replace(trim(unnest(string_split(high_symmetry_paths, ';'))), '[^\\p{L}]+', '', 'g')) AS c
  FROM t WHERE confirmed_particles <> '' AND NOT contains(confirmed_particles, ';')) WHERE c <> ''),
n AS (SELECT row_number() OVER () AS i, * FROM p),
m AS (SELECT DISTINCT i, particle FROM n JOIN k ON n.g = k.g AND (n.c = k.c OR n.c = reverse(k.c))),
l AS (SELECT i, count(*) AS z, string_agg(particle, ';' ORDER BY particle) AS candidates FROM m GROUP BY 1)
SELECT topology_row_id, path, CASE WHEN z = 1 THEN 'unique' WHEN z > 1 THEN 'ambiguous' ELSE 'not_indexed' END AS path_status, coalesce(candidates, '') AS candidates FROM n LEFT JOIN l USING (i)""".replace("\\\\", "\\"),
    "compared_paths": r"""
WITH t AS (SELECT * FROM topology_labels WHERE spacegroup_number IS NOT NULL),
o AS (SELECT spacegroup_number AS g, trim(unnest(string_split(high_symmetry_paths, ';'))) AS path, coalesce(crossing_count, 0) AS n FROM t),
s AS (SELECT g, path, sum(n)::BIGINT AS crossings, upper(regexp_replace(path, '[^\p{L}]+', '', 'g')) AS c FROM o WHERE path <> '' GROUP BY 1, 2),
k AS (SELECT DISTINCT g, least(c, reverse(c)) AS c, particle FROM (SELECT t.spacegroup_number AS g, confirmed_particles AS particle, upper(regexp_replace(trim(unnest(string_split(high_symmetry_paths, ';'))), '[^\p{L}]+', '', 'g')) AS c
  FROM t WHERE confirmed_particles <> '' AND NOT contains(confirmed_particles, ';')) WHERE c <> ''),
m AS (SELECT g, c, count(*) AS n FROM k GROUP BY 1, 2)
SELECT s.g AS spacegroup_number, path, crossings, particle, CASE WHEN m.n IS NULL THEN 'not_indexed' WHEN m.n = 1 THEN 'unique' ELSE 'ambiguous' END AS classification FROM s LEFT JOIN m ON m.g = s.g AND m.c = least(s.c, reverse(s.c)) LEFT JOIN k ON k.g = s.g AND k.c = least(s.c, reverse(s.c))""".replace("\\\\", "\\"),
    "lookup_expand": """
WITH t AS (SELECT * FROM topology_labels WHERE spacegroup_number IS NOT NULL),
a AS (SELECT spacegroup_number AS g, 0 AS c, topology_row_id AS r, trim(unnest(string_split(confirmed_particles, ';'))) AS p, unnest(range(len(string_split(confirmed_particles, ';')))) AS i FROM t
  UNION ALL SELECT spacegroup_number, 1, topology_row_id, trim(unnest(string_split(compatible_particles, ';'))), unnest(range(len(string_split(compatible_particles, ';')))) FROM t),
f AS (SELECT g, p, min(c * 1000000000 + r * 100 + i) AS o FROM a WHERE p <> '' GROUP BY 1, 2)
SELECT k.g AS spacegroup_number, coalesce(string_agg(p, ';' ORDER BY o), '') AS particles FROM (SELECT DISTINCT spacegroup_number AS g FROM t) k LEFT JOIN f ON k.g = f.g GROUP BY 1""",
    "evidence_ladder": """
WITH t AS (SELECT result_name, sum(coalesce(crossing_count, 0)) AS n, count(*) FILTER (strict_topology_hit) AS s, bool_and(coalesce(soc, false)) AS soc, bool_or(coalesce(analysis_completed, false)) AS done FROM topology_labels WHERE result_name IS NOT NULL GROUP BY 1)
SELECT result_name, CASE WHEN n = 0 THEN 'L0' WHEN s > 0 THEN 'L3' ELSE 'L2' END AS level,
  concat_ws('; ', CASE WHEN NOT done THEN 'analysis failed' END, CASE WHEN NOT soc THEN 'no spin-orbit coupling' END, CASE WHEN n = 0 THEN 'no crossing' END) AS limitations FROM t""",
    "crossing_diagnostics": """
SELECT event_id, CASE WHEN value / 1000 / 0.05 <= 0.25 THEN 'well_below_threshold' WHEN value / 1000 / 0.05 <= 0.75 THEN 'below_threshold' ELSE 'near_threshold' END AS gap_class,
  CASE WHEN abs((event_id % 21 - 10) / 10) <= 0.1 THEN 'within_0.1_eV_of_fermi' WHEN abs((event_id % 21 - 10) / 10) <= 0.5 THEN 'within_0.5_eV_of_fermi' ELSE 'far_from_fermi' END AS energy_class FROM events""",
}
