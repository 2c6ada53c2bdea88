"""Lattices, periodic distances and neighbours, scalers and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lattice_matrix(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Rows of a cell matrix: a in the xz plane, c along z; cosines are kept within [-1, 1]."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    sa, sb = (F.sin(F.radians(x)) for x in (alpha, beta))
    star = F.acos(F.least(F.greatest((ca * cb - cg) / (sa * sb), F.lit(-1.0)), F.lit(1.0)))
    return F.array(F.array(a * sb, F.lit(0.0), a * cb), F.array(-b * sa * F.cos(star), b * sa * F.sin(star), b * ca), F.array(F.lit(0.0), F.lit(0.0), c))


def volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    return a * b * c * F.sqrt(F.greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, F.lit(0.0)))


def wrap(x: Column) -> Column:
    """Into [0, 1)."""
    return F.pmod(x, F.lit(1.0))


def periodic_gap(x: Column, y: Column) -> Column:
    """Least difference of two fractional coordinates."""
    d = F.pmod(x - y, F.lit(1.0))
    return F.least(d, 1 - d)


def site_table(df: DataFrame, id_: str, structure: str) -> DataFrame:
    """(id, site, element, fractional coordinates, Cartesian coordinates, matrix)"""
    p = [F.col(f"{structure}.lattice.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")]
    rows = df.where(F.col(structure).isNotNull()).select(id_, lattice_matrix(*p).alias("m"), F.posexplode(f"{structure}.sites").alias("site", "s"))
    return rows.select(id_, "site", F.col("s.element").alias("element"), F.col("s.frac_coords").alias("f"), "m", cartesian(F.col("s.frac_coords"), F.col("m")).alias("x"))


def cartesian(f: Column, m: Column) -> Column:
    return F.array(*[f[0] * m[0][k] + f[1] * m[1][k] + f[2] * m[2][k] for k in range(3)])


def images() -> Column:
    """The 27 shifts of a cell by -1, 0 or 1 along each axis. Enough for cells that are not strongly skewed."""
    return F.array(*[F.array(F.lit(i), F.lit(j), F.lit(k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])


def _placed(df: DataFrame, id_: str, structure: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, kept columns, m, x): the matrix and the Cartesian coordinates of all sites of each structure."""
    kept = keep or {}
    p = [F.col(f"{structure}.lattice.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")]
    rows = df.where(F.col(structure).isNotNull()).select(id_, *[c.alias(n) for n, c in kept.items()], lattice_matrix(*p).alias("m"), F.transform(f"{structure}.sites", lambda s: s["frac_coords"]).alias("f"))
    return rows.select(id_, *kept, "m", F.transform("f", lambda f: cartesian(f, F.col("m"))).alias("x"))


def _distance() -> Column:
    """From xi to the image of xj."""
    shift = cartesian(F.col("image").cast("array<double>"), F.col("m"))
    return F.sqrt(sum(((F.col("xj")[k] + shift[k] - F.col("xi")[k]) ** 2 for k in range(3)), F.lit(0.0)))


_ITSELF = "i = j AND image[0] = 0 AND image[1] = 0 AND image[2] = 0"


def neighbour_pairs(df: DataFrame, id_: str, structure: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, i, j, image, distance) of all site pairs and images of a cell; a site meets its own images, not itself.

    Pairs are generated from each structure's row: nothing is shuffled. ``keep``: further columns of that row, such as a
    radius. Joined to the pairs by id instead, they would meet a table that is thousands of times its file, which a plan
    takes for small and broadcasts.
    """
    kept = list(keep or {})
    one = _placed(df, id_, structure, keep).select(id_, *kept, "m", "x", F.posexplode("x").alias("i", "xi"))
    two = one.select(id_, *kept, "m", "i", "xi", F.posexplode("x").alias("j", "xj"))
    met = two.withColumn("image", F.explode(images())).where(f"NOT ({_ITSELF})")
    return met.select(id_, *kept, "i", "j", "image", _distance().alias("distance"))


def least_distance(df: DataFrame, id_: str, structure: str) -> DataFrame:
    """(id, least_distance) of each structure, over its pairs of sites, and a site and its own images.

    A pair's distance is the same from either site, so only i <= j are generated, from the structure's row; only the
    minima are shuffled.
    """
    one = _placed(df, id_, structure).select(id_, "m", "x", F.posexplode("x").alias("i", "xi"))
    rest = F.slice(F.col("x"), F.col("i") + 1, F.size("x"))
    two = one.select(id_, "m", "i", "xi", F.posexplode(rest).alias("k", "xj")).withColumn("j", F.col("i") + F.col("k"))
    met = two.withColumn("image", F.explode(images())).where(f"NOT ({_ITSELF})")
    return met.groupBy(id_).agg(F.min(_distance()).alias("least_distance"))


def nearest_neighbours(pairs: DataFrame, id_: str, k: int, tolerance: float = 0.01) -> DataFrame:
    """Pairs nearer (squared) than the (k+1)-th neighbour plus a tolerance: ties may give more than k."""
    w = Window.partitionBy(id_, "i").orderBy("distance", "j", F.array_join(F.col("image").cast("array<string>"), ",")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.nth_value("distance", k + 1).over(w)
    return pairs.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col("distance") ** 2 < F.col("__cut") ** 2 + tolerance)).drop("__cut")


def symmetric_edges(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Edges with i < j and their reverses."""
    one = edges.where(F.col(i) < F.col(j))
    return one.unionByName(one.withColumn("__i", F.col(i)).withColumn(i, F.col(j)).withColumn(j, F.col("__i")).drop("__i"))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds c_scaled = (c - mean) / population deviation; NaN is ignored and gives 0, a deviation of 0 counts as 1."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    stats = df.agg(*[f(v).alias(f"{c}_{n}") for c, v in clean.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    for c, v in clean.items():
        s = F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
        joined = joined.withColumn(f"{c}_scaled", F.coalesce((v - F.col(f"{c}_m")) / s, F.lit(0.0)))
    return joined.drop(*[f"{c}_{n}" for c in columns for n in "ms"])


def cosine_schedule(spark: SparkSession, steps: int, s: float = 0.008) -> DataFrame:
    """(t, beta, alpha_bar) of a cosine noise schedule, betas within [1e-4, 0.9999]."""
    f = lambda t: F.cos((t / steps + s) / (1 + s) * F.pi() / 2) ** 2
    t = F.col("t")
    beta = F.least(F.greatest(1 - f(t) / f(t - 1), F.lit(1e-4)), F.lit(0.9999))
    rows = spark.range(1, steps + 1).select(F.col("id").alias("t")).withColumn("beta", beta)
    order = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    return rows.withColumn("alpha_bar", F.exp(F.sum(F.ln(1 - F.col("beta"))).over(order)))


def matrix_parameters(m: Column) -> list[Column]:
    """Lengths and angles (degrees) of the rows of a matrix."""
    dot = lambda i, j: sum((m[i][k] * m[j][k] for k in range(3)), F.lit(0.0))
    length = [F.sqrt(dot(i, i)) for i in range(3)]
    angle = lambda i, j: F.degrees(F.acos(F.least(F.greatest(dot(i, j) / (length[i] * length[j]), F.lit(-1.0)), F.lit(1.0))))
    return [*length, angle(1, 2), angle(0, 2), angle(0, 1)]


def fractional(x: Column, m: Column) -> Column:
    """Cartesian to fractional coordinates by the cofactors of the matrix; null for a flat cell."""
    c = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum((m[0][j] * c[0][j] for j in range(3)), F.lit(0.0))
    return F.array(*[sum((x[k] * c[i][k] for k in range(3)), F.lit(0.0)) / F.nullif(det, F.lit(0.0)) for i in range(3)])


def crystal_system(group: Column) -> Column:
    """Fixed ranges of space group numbers; null outside 1..230."""
    case = F.when((group < 1) | (group > 230), None)
    for last, name in ((2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic")):
        case = case.when(group <= last, name)
    return case


def wrapped_normal(x: Column, sigma: Column, terms: int = 10) -> Column:
    """Density, up to a factor, of a normal wrapped onto [0, 1)."""
    return F.aggregate(F.sequence(F.lit(-terms), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.exp(-((x + k) ** 2) / (2 * sigma**2)))


def wrapped_score(x: Column, sigma: Column, terms: int = 10) -> Column:
    """Derivative of the log-density of wrapped_normal."""
    top = F.aggregate(F.sequence(F.lit(-terms), F.lit(terms)), F.lit(0.0), lambda acc, k: acc - (x + k) / sigma**2 * F.exp(-((x + k) ** 2) / (2 * sigma**2)))
    return top / wrapped_normal(x, sigma, terms)


def geometric_schedule(spark: SparkSession, steps: int, low: float, high: float) -> DataFrame:
    """(t, sigma) with sigma from low to high in equal ratios."""
    return spark.range(1, steps + 1).select(F.col("id").alias("t"), (low * F.pow(F.lit(high / low), (F.col("id") - 1) / F.lit(float(max(1, steps - 1))))).alias("sigma"))


def sinusoidal(x: Column, frequencies: int) -> Column:
    """Sines, then cosines, of 2 pi k x for k = 0 .. frequencies - 1."""
    k = F.sequence(F.lit(0), F.lit(frequencies - 1))
    return F.concat(F.transform(k, lambda i: F.sin(2 * F.pi() * i * x)), F.transform(k, lambda i: F.cos(2 * F.pi() * i * x)))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1).otherwise(0))


def argmax(values: Column) -> Column:
    """Position from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def plane_spacings(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> list[Column]:
    """Distances of neighbouring lattice planes along each axis: the volume over the area of the other two vectors."""
    v = volume(a, b, c, alpha, beta, gamma)
    return [v / (b * c * F.sin(F.radians(alpha))), v / (a * c * F.sin(F.radians(beta))), v / (a * b * F.sin(F.radians(gamma)))]


def effective_radius(*parameters: Column) -> Column:
    """The radius of neighbour graphs: the least plane spacing and a hundredth, whatever radius is asked for."""
    return F.least(*plane_spacings(*parameters)) + 0.01


def radius_graph(pairs: DataFrame, id_: str, radius: Column, most: int | None = None) -> DataFrame:
    """Pairs (id, i, j, image, distance) within the radius; with ``most`` only the nearest images of each ordered pair of sites."""
    near = pairs.where(F.col("distance") <= radius)
    if most is None:
        return near
    order = Window.partitionBy(id_, "i", "j").orderBy("distance", F.array_join(F.col("image").cast("array<string>"), ","))  # at most 27 images a pair
    return near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def nearest_images(pairs: DataFrame, id_: str) -> DataFrame:
    """(id, i, j, distance, image) of the nearest image of each ordered pair; of equals the first image."""
    best = F.min_by(F.struct("distance", "image"), F.struct(F.round("distance", 9).alias("d"), F.col("image")))
    return pairs.groupBy(id_, "i", "j").agg(best.alias("__b")).select(id_, "i", "j", "__b.distance", "__b.image")


def edge_distances(edges: DataFrame, sites: DataFrame, id_: str) -> DataFrame:
    """edges (id, i, j, image) with the distance and Cartesian vector from site i to that image of site j; edges of unknown sites vanish.

    A structure's sites meet its edges as one list, so both tables are shuffled once, by id. The join is told to merge:
    sites are many times the file they come from, and a plan that goes by the file would broadcast them.
    """
    lists = sites.where(F.col(id_).isNotNull() & F.col("site").isNotNull()).groupBy(id_).agg(F.collect_list(F.struct("site", "x", "m")).alias("__s"))
    met = edges.join(lists.hint("merge"), id_)
    ends = met.withColumn("__a", F.filter("__s", lambda s: s["site"] == F.col("i"))).withColumn("__b", F.filter("__s", lambda s: s["site"] == F.col("j")))
    both = ends.drop("__s").withColumn("__a", F.explode("__a")).withColumn("__b", F.explode("__b"))  # one of each, unless a site is listed twice
    shift = cartesian(F.col("image").cast("array<double>"), F.col("__a.m"))
    vector = F.array(*[F.col("__b.x")[k] + shift[k] - F.col("__a.x")[k] for k in range(3)])
    out = both.withColumn("vector", vector).drop("__a", "__b")
    return out.withColumn("distance", F.sqrt(sum((F.col("vector")[k] ** 2 for k in range(3)), F.lit(0.0))))


def full_edges(df: DataFrame, id_: str, size: Column) -> DataFrame:
    """(id, i, j) for every ordered pair of different nodes 0 .. size - 1 of each graph, made within its row."""
    nodes = F.sequence(F.lit(0), size - 1)
    pairs = F.flatten(F.transform(nodes, lambda i: F.transform(F.filter(nodes, lambda j: j != i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return df.where(size > 0).select(id_, F.explode(pairs).alias("e")).select(id_, "e.*")


def both_ways(edges: DataFrame, id_: str) -> DataFrame:
    """Each bond (id, i, j, image) and its reverse with the image turned round."""
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.transform("image", lambda x: -x).alias("image"))
    return edges.select(id_, F.explode(F.array(F.struct("i", "j", "image"), back)).alias("e")).select(id_, "e.*")


def scaled_lattice(lengths: list[Column], angles: list[Column], atoms: Column) -> Column:
    """Lengths over the cube root of the number of atoms, then the angles."""
    return F.array(*[x / F.pow(atoms.cast("double"), F.lit(1 / 3)) for x in lengths], *angles)


def merged_sites(df: DataFrame, id_: str, coords: Column, tolerance: float = 0.25) -> DataFrame:
    """(id, kept): places of the sites that stay when each one within the tolerance of an earlier kept one, along every
    axis and under periodic bounds, is left out. Coordinates are an array of triples; a fold within the row."""
    near = lambda p, q: F.greatest(*[periodic_gap(p[k], q[k]) for k in range(3)]) < tolerance - 1e-9
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<array<double>>").alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        new = ~F.exists(acc["at"], lambda q: near(p, q))
        return F.struct(
            F.when(new, F.concat(acc["kept"], F.array(acc["n"]))).otherwise(acc["kept"]).alias("kept"), F.when(new, F.concat(acc["at"], F.array(p))).otherwise(acc["at"]).alias("at"), (acc["n"] + 1).alias("n")
        )

    return df.select(id_, F.aggregate(coords, start, step, lambda s: s["kept"]).alias("kept"))


def schedule(spark: SparkSession, kind: str, steps: int, first: float, last: float) -> DataFrame:
    """(t, beta) of a linear, quadratic or sigmoid schedule from first to last; t from 1."""
    x = (F.col("t") - 1) / F.lit(float(max(1, steps - 1)))
    forms = {"linear": first + x * (last - first), "quadratic": (first**0.5 + x * (last**0.5 - first**0.5)) ** 2, "sigmoid": 1 / (1 + F.exp(6 - 12 * x)) * (last - first) + first}
    if kind not in forms:
        raise ValueError(f"no schedule {kind}; there are {', '.join(forms)}")
    return spark.range(1, steps + 1).select(F.col("id").alias("t")).withColumn("beta", forms[kind])


def sigma_norm(sigmas: DataFrame, samples: int = 2000, terms: int = 10) -> DataFrame:
    """(t, norm): the mean squared score of the wrapped normal at each sigma, over evenly spaced quantiles of it rather than
    random draws, so that runs agree. ``sigmas`` holds t and sigma."""
    u = (F.col("k") + 0.5) / samples
    # a normal quantile by a rational approximation good to 4.5e-4
    tail = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    z = tail - (2.515517 + 0.802853 * tail + 0.010328 * tail**2) / (1 + 1.432788 * tail + 0.189269 * tail**2 + 0.001308 * tail**3)
    rows = sigmas.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    x = F.pmod(F.when(u < 0.5, -z).otherwise(z) * F.col("sigma"), F.lit(1.0))
    return rows.groupBy("t").agg(F.avg(wrapped_score(x, F.col("sigma"), terms) ** 2).alias("norm"))


def block_product(vector: Column, blocks: list[tuple[int, Column]]) -> Column:
    """A row vector times a block-diagonal matrix; ``blocks``: size and matrix (an array of rows) of each block, in order."""
    out, at = [], 0
    for size, m in blocks:
        for j in range(size):
            out.append(sum((vector[at + i] * m[i][j] for i in range(size)), F.lit(0.0)))
        at += size
    return F.array(*out)


def lattice_mask(group: Column) -> tuple[Column, Column]:
    """Which of the six lattice coefficients are free for a space group (1 or 0), and the constants that are added."""
    ones = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    system = crystal_system(group)
    mask = (
        F.when(system == "triclinic", ones(1, 1, 1, 1, 1, 1)).when(system == "monoclinic", ones(0, 1, 0, 1, 1, 1)).when(system == "orthorhombic", ones(0, 0, 0, 1, 1, 1))
        .when(system.isin("tetragonal", "trigonal", "hexagonal"), ones(0, 0, 0, 0, 1, 1)).when(system == "cubic", ones(0, 0, 0, 0, 0, 1))
    )
    turned = F.when(system.isin("trigonal", "hexagonal"), F.lit(-math.log(3) / 4)).otherwise(0.0)
    return mask, F.when(mask.isNotNull(), F.array(turned, *[F.lit(0.0)] * 5))


#: Centring letters of space group symbols by number.
CENTRINGS = ("P", "I", "F", "A", "B", "C", "R")


def centring(symbol: Column) -> Column:
    """The number of a space group symbol's centring letter; null for other symbols."""
    place = F.array_position(F.array(*[F.lit(x) for x in CENTRINGS]), F.upper(F.substring(F.trim(symbol), 1, 1)))
    return F.when(place > 0, (place - 1).cast("int"))


def lattice_logarithm(df: DataFrame, id_: str, matrix: str) -> DataFrame:
    """(id, k, back): six coefficients of the matrix logarithm of the symmetric stretch of each cell in an orthogonal basis,
    and the stretch found again from them. The stretch is the root of M M^T, so its logarithm is half that of M M^T.

    Basis: the three off-diagonal pairs, then diag(1, -1, 0), diag(1, 1, -2) and the identity. Flat cells give nulls.
    """
    import numpy as np
    import pandas as pd

    pair = lambda i, j: np.array([[float((r, c) in ((i, j), (j, i))) for c in range(3)] for r in range(3)])
    basis = [pair(0, 1), pair(0, 2), pair(1, 2), np.diag([1.0, -1, 0]), np.diag([1.0, 1, -2]), np.eye(3)]

    def run(batches):
        for pdf in batches:
            ks, backs = [], []
            for m in pdf[matrix]:
                m = np.array([list(r) for r in m], float)
                values, vectors = np.linalg.eigh(m @ m.T)
                if not np.isfinite(values).all() or values.min() <= 1e-12:
                    ks.append(None)
                    backs.append(None)
                    continue
                s = (vectors * (0.5 * np.log(values))) @ vectors.T
                k = [float((s * b).sum() / (b * b).sum()) for b in basis]
                values, vectors = np.linalg.eigh(sum(x * b for x, b in zip(k, basis)))
                ks.append(k)
                backs.append(((vectors * np.exp(values)) @ vectors.T).ravel().tolist())
            yield pd.DataFrame({id_: pdf[id_], "k": ks, "back": backs})

    kind = df.schema[id_].dataType.simpleString()
    return df.where(F.col(matrix).isNotNull()).select(id_, matrix).mapInPandas(run, f"{id_} {kind}, k array<double>, back array<double>")
