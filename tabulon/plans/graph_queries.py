"""Periodic graphs, lattices and schedules of reference structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import geometry
from tabulon.session import table

_KEYS = ("a", "b", "c", "alpha", "beta", "gamma")


def _p():
    return [F.col(f"structure.lattice.{k}") for k in _KEYS]


def _sites(spark, d):
    return geometry.site_table(table(spark, d, "reference_snapshot").select("snapshot_row_id", "structure"), "snapshot_row_id", "structure")


def effective_radius(spark, d):
    return table(spark, d, "reference_snapshot").where("structure IS NOT NULL").select("snapshot_row_id", F.round(geometry.effective_radius(*_p()), 5).alias("radius"))


def radius_graph(spark, d):
    """Edges within each structure's effective radius, at most the two nearest images a pair of sites."""
    pairs = geometry.neighbour_pairs(table(spark, d, "reference_snapshot"), "snapshot_row_id", "structure", {"radius": geometry.effective_radius(*_p())})
    near = geometry.radius_graph(pairs, "snapshot_row_id", F.col("radius") - 1e-7, 2)
    return near.groupBy("snapshot_row_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("distance"), 4).alias("mean"))


def nearest_images(spark, d):
    """Distances of sites 0 and 1 of each structure at the nearest image."""
    best = geometry.nearest_images(geometry.neighbour_pairs(table(spark, d, "reference_snapshot"), "snapshot_row_id", "structure").where("i = 0 AND j = 1"), "snapshot_row_id")
    return best.select("snapshot_row_id", F.round(F.col("distance") ** 2, 4).alias("squared"))


def edge_distances(spark, d):
    """Distances along given edges: each site to the next one, in the same cell and one cell up the third axis."""
    sites = _sites(spark, d)
    edges = sites.select("snapshot_row_id", F.col("site").alias("i"), (F.col("site") + 1).alias("j"), F.explode(F.array(F.array(F.lit(0), F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0), F.lit(1)))).alias("image"))
    out = geometry.edge_distances(edges, sites, "snapshot_row_id")
    return out.select("snapshot_row_id", "i", F.col("image")[2].alias("up"), F.round("distance", 4).alias("distance"))


def full_edges(spark, d):
    s = table(spark, d, "reference_snapshot").where("structure IS NOT NULL")
    return geometry.full_edges(s, "snapshot_row_id", F.size("structure.sites")).groupBy("snapshot_row_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("i") * 7 + F.col("j")).alias("mark"))


def bonds_both_ways(spark, d):
    """Bonds from the first site to the others, in both directions."""
    sites = _sites(spark, d).where("site > 0").select("snapshot_row_id", F.lit(0).alias("i"), F.col("site").alias("j"), F.array(F.lit(0), F.lit(1), F.lit(-1)).alias("image"))
    return geometry.both_ways(sites, "snapshot_row_id").select("snapshot_row_id", "i", "j", F.array_join(F.col("image").cast("array<string>"), ",").alias("image"))


def scaled_lattices(spark, d):
    p = _p()
    v = geometry.scaled_lattice(p[:3], p[3:], F.size("structure.sites"))
    return table(spark, d, "reference_snapshot").where("structure IS NOT NULL").select("snapshot_row_id", F.round(v[0], 5).alias("a"), F.round(v[2], 5).alias("c"), F.round(v[5], 3).alias("gamma"))


def merged_sites(spark, d):
    """Sites that stay when those near an earlier one are left out."""
    s = table(spark, d, "reference_snapshot").where("structure IS NOT NULL")
    out = geometry.merged_sites(s, "snapshot_row_id", F.transform("structure.sites", lambda x: x["frac_coords"]))
    return out.select("snapshot_row_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


def beta_schedules(spark, d):
    """Linear, quadratic and sigmoid schedules side by side."""
    out = None
    for kind in ("linear", "quadratic", "sigmoid"):
        one = geometry.schedule(spark, kind, 200, 0.0001, 0.02).select("t", F.round("beta", 7).alias("beta"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def sigma_norms(spark, d):
    """Mean squared scores at the sigmas of a geometric schedule."""
    return geometry.sigma_norm(geometry.geometric_schedule(spark, 20, 0.005, 0.5), 500).select("t", F.round("norm", 4).alias("norm"))


def block_products(spark, d):
    """One-hot vectors of two parts times two transition matrices."""
    m = lambda keep, n: F.array(*[F.array(*[F.lit((1 - keep) / n + keep * (i == j)) for j in range(n)]) for i in range(n)])
    p = table(spark, d, "part")
    v = F.concat(geometry.one_hot(F.col("p_size") % 2, 2), geometry.one_hot(F.col("p_size") % 3, 3))
    out = geometry.block_product(v, [(2, m(0.8, 2)), (3, m(0.7, 3))])
    return p.select("p_partkey", *[F.round(out[i], 6).alias(f"v{i}") for i in range(5)])


def lattice_masks(spark, d):
    t = table(spark, d, "structure_catalog").select("actual_spacegroup", "actual_spacegroup_symbol").where("actual_spacegroup IS NOT NULL AND actual_spacegroup_symbol IS NOT NULL").distinct()
    mask, add = geometry.lattice_mask(F.col("actual_spacegroup"))
    return t.select("actual_spacegroup", "actual_spacegroup_symbol", F.array_join(mask.cast("array<int>").cast("array<string>"), "").alias("mask"), F.round(add[0], 6).alias("added"), geometry.centring(F.col("actual_spacegroup_symbol")).alias("centring"))


def lattice_logarithms(spark, d):
    """Volumes found again from the logarithms of the cells."""
    r = table(spark, d, "reference_snapshot").where("structure IS NOT NULL").select("snapshot_row_id", geometry.lattice_matrix(*_p()).alias("m"))
    return geometry.lattice_logarithm(r, "snapshot_row_id", "m").where("k IS NOT NULL").select("snapshot_row_id", F.round(F.exp(3 * F.col("k")[5]), 3).alias("volume"))


QUERIES = {
    f.__name__: f
    for f in (effective_radius, radius_graph, nearest_images, edge_distances, full_edges, bonds_both_ways, scaled_lattices, merged_sites, beta_schedules, sigma_norms, block_products, lattice_masks, lattice_logarithms)
}

_CELLS = """
st AS (SELECT snapshot_row_id AS id, structure.lattice AS l, structure.sites AS z FROM reference_snapshot WHERE structure IS NOT NULL),
cc AS (SELECT id, z, l.a AS a, l.b AS b, l.c AS c, cos(radians(l.alpha)) AS ca, cos(radians(l.beta)) AS cb, cos(radians(l.gamma)) AS cg, sin(radians(l.alpha)) AS sa, sin(radians(l.beta)) AS sb, sin(radians(l.gamma)) AS sg FROM st),
vv AS (SELECT *, a * b * c * sqrt(greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, 0)) AS v, acos(least(greatest((ca * cb - cg) / (sa * sb), -1), 1)) AS gs FROM cc),
rr AS (SELECT *, least(v / (b * c * sa), v / (a * c * sb), v / (a * b * sg)) + 0.01 AS radius FROM vv)"""
_PLACES = (
    _CELLS
    + """,
xx AS (SELECT id, radius, a, b, c, ca, cb, sa, sb, gs, unnest(z).frac_coords AS f, generate_subscripts(z, 1) - 1 AS site FROM rr),
pp AS (SELECT id, radius, site, f[1] * a * sb - f[2] * b * sa * cos(gs) AS x, f[2] * b * sa * sin(gs) AS y, f[1] * a * cb + f[2] * b * ca + f[3] * c AS z, a * sb AS ax, a * cb AS az, -b * sa * cos(gs) AS bx, b * sa * sin(gs) AS by_, b * ca AS bz, c AS cz FROM xx)"""
)
_IMAGES = "k3 AS (SELECT unnest([-1, 0, 1]) AS s), ii AS (SELECT p.s AS i, q.s AS j, r.s AS k FROM k3 p, k3 q, k3 r)"
_D2 = "(q.x + i.i * p.ax + i.j * p.bx - p.x) ** 2 + (q.y + i.j * p.by_ - p.y) ** 2 + (q.z + i.i * p.az + i.j * p.bz + i.k * p.cz - p.z) ** 2"
_SYSTEM = "CASE WHEN g BETWEEN 1 AND 2 THEN 0 WHEN g BETWEEN 3 AND 15 THEN 1 WHEN g BETWEEN 16 AND 74 THEN 2 WHEN g BETWEEN 75 AND 142 THEN 3 WHEN g BETWEEN 143 AND 194 THEN 4 WHEN g BETWEEN 195 AND 230 THEN 5 END"
ORACLE = {
    "effective_radius": f"WITH {_CELLS} SELECT id AS snapshot_row_id, round(radius, 5) AS radius FROM rr",
    "radius_graph": f"""WITH {_PLACES}, {_IMAGES},
dd AS (SELECT p.id, p.site AS a, q.site AS b, p.radius, sqrt({_D2}) AS d FROM pp p JOIN pp q ON p.id = q.id, ii i WHERE NOT (p.site = q.site AND i.i = 0 AND i.j = 0 AND i.k = 0)),
nn AS (SELECT id, d, row_number() OVER (PARTITION BY id, a, b ORDER BY d) AS n FROM dd WHERE d <= radius - 1e-7)
SELECT id AS snapshot_row_id, count(*) AS edges, round(avg(d), 4) AS mean FROM nn WHERE n <= 2 GROUP BY 1""",
    "nearest_images": f"WITH {_PLACES}, {_IMAGES} SELECT p.id AS snapshot_row_id, round(min({_D2}), 4) AS squared FROM pp p JOIN pp q ON p.id = q.id AND p.site = 0 AND q.site = 1, ii i GROUP BY 1",
    "edge_distances": f"WITH {_PLACES}, i AS (SELECT 0 AS i, 0 AS j, unnest([0, 1]) AS k) SELECT p.id AS snapshot_row_id, p.site AS i, i.k AS up, round(sqrt({_D2}), 4) AS distance FROM pp p JOIN pp q ON p.id = q.id AND q.site = p.site + 1, i",
    "full_edges": "WITH n AS (SELECT snapshot_row_id, unnest(generate_series(0, len(structure.sites) - 1)) AS i FROM reference_snapshot WHERE structure IS NOT NULL) SELECT snapshot_row_id, count(*) AS edges, sum(a.i * 7 + b.i)::BIGINT AS mark FROM n a JOIN n b USING (snapshot_row_id) WHERE a.i <> b.i GROUP BY 1",
    "bonds_both_ways": "WITH n AS (SELECT snapshot_row_id, unnest(generate_series(1, len(structure.sites) - 1)) AS j FROM reference_snapshot WHERE structure IS NOT NULL) SELECT snapshot_row_id, 0 AS i, j, '0,1,-1' AS image FROM n UNION ALL SELECT snapshot_row_id, j, 0, '0,-1,1' FROM n",
    "scaled_lattices": "SELECT snapshot_row_id, round(structure.lattice.a / len(structure.sites) ** (1.0 / 3), 5) AS a, round(structure.lattice.c / len(structure.sites) ** (1.0 / 3), 5) AS c, round(structure.lattice.gamma, 3) AS gamma FROM reference_snapshot WHERE structure IS NOT NULL",
    "merged_sites": """
WITH s AS (SELECT snapshot_row_id AS id, list_transform(structure.sites, lambda x: x.frac_coords) AS f FROM reference_snapshot WHERE structure IS NOT NULL),
x AS (SELECT id, unnest(f) AS p, generate_subscripts(f, 1) - 1 AS n FROM s),
r AS (SELECT a.id, a.n AS i, b.n AS j FROM x a JOIN x b ON a.id = b.id AND a.n < b.n AND list_max([least(abs(a.p[k] - b.p[k]) % 1.0, 1 - abs(a.p[k] - b.p[k]) % 1.0) for k in [1, 2, 3]]) < 0.25 - 1e-9),
l AS (SELECT id, list(DISTINCT [i, j]) AS e FROM r GROUP BY 1),
o AS (SELECT s.id, list_reduce(list_prepend([-1]::BIGINT[], list_transform(generate_series(0, len(f) - 1), lambda n: [n])), lambda acc, m: CASE WHEN len(list_filter(coalesce(e, []), lambda t: t[2] = m[1] AND list_contains(acc, t[1]))) > 0 THEN acc ELSE list_append(acc, m[1]) END) AS kept FROM s LEFT JOIN l USING (id))
SELECT id AS snapshot_row_id, array_to_string(kept[2:], ',') AS kept FROM o""",
    "beta_schedules": """
WITH t AS (SELECT unnest(generate_series(1, 200)) AS t), x AS (SELECT t, (t - 1) / 199.0::DOUBLE AS x FROM t)
SELECT t, round(0.0001 + x * 0.0199, 7) AS beta, 'linear' AS kind FROM x UNION ALL SELECT t, round((sqrt(0.0001::DOUBLE) + x * (sqrt(0.02::DOUBLE) - sqrt(0.0001::DOUBLE))) ** 2, 7), 'quadratic' FROM x UNION ALL SELECT t, round(1 / (1 + exp(6 - 12 * x)) * 0.0199 + 0.0001, 7), 'sigmoid' FROM x""",
    "block_products": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.1 END AS v0, CASE WHEN p_size % 2 = 1 THEN 0.9 ELSE 0.1 END AS v1, CASE WHEN p_size % 3 = 0 THEN 0.8 ELSE 0.1 END AS v2, CASE WHEN p_size % 3 = 1 THEN 0.8 ELSE 0.1 END AS v3, CASE WHEN p_size % 3 = 2 THEN 0.8 ELSE 0.1 END AS v4 FROM part",
    "lattice_masks": f"""
WITH t AS (SELECT DISTINCT actual_spacegroup AS g, actual_spacegroup_symbol AS s FROM structure_catalog WHERE actual_spacegroup IS NOT NULL AND actual_spacegroup_symbol IS NOT NULL), u AS (SELECT *, {_SYSTEM} AS c FROM t)
SELECT g AS actual_spacegroup, s AS actual_spacegroup_symbol, ['111111', '010111', '000111', '000011', '000011', '000001'][c + 1] AS mask, CASE WHEN c = 4 THEN round(-ln(3) / 4, 6) WHEN c IS NOT NULL THEN 0.0 END AS added, nullif(strpos('PIFABCR', upper(left(trim(s), 1))), 0) - 1 AS centring FROM u""",
    "lattice_logarithms": f"WITH {_CELLS} SELECT id AS snapshot_row_id, round(v, 3) AS volume FROM rr",
}
