"""Meshes and point clouds as DataFrames: vertices (shape_id, vid, x, y, z), faces (shape_id, fid, i0, i1, i2)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def centroid(points: DataFrame) -> DataFrame:
    """(shape_id, cx, cy, cz)."""
    return points.groupBy("shape_id").agg(*(F.avg(c).alias(f"c{c}") for c in AXES))


def bounding_box(points: DataFrame) -> DataFrame:
    """Minima, maxima and extents of each shape."""
    return points.groupBy("shape_id").agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))), *((F.max(c) - F.min(c)).alias(f"extent_{c}") for c in AXES))


def normalize_scale(points: DataFrame, method: str = "bbox") -> DataFrame:
    """Points about their centroid, over the bounding box diagonal or the RMS radius, with the factor; a factor below 1e-12 leaves them unscaled."""
    mean = centroid(points)
    centred = points.join(mean, "shape_id").select("shape_id", "vid", *((F.col(c) - F.col(f"c{c}")).alias(c) for c in AXES))
    if method == "bbox":
        size = F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in AXES), F.lit(0.0)))
    elif method == "rms":
        size = F.sqrt(F.avg(sum((F.col(c) * F.col(c) for c in AXES), F.lit(0.0))))
    else:
        raise ValueError(f"unknown method {method}")
    factor = centred.groupBy("shape_id").agg(size.alias("factor")).withColumn("factor", F.when(F.col("factor") < 1e-12, 1.0).otherwise(F.col("factor")))
    return centred.join(factor, "shape_id").select("shape_id", "vid", *((F.col(c) / F.col("factor")).alias(c) for c in AXES), "factor")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: x0, y0, ..., z2; three joins by vertex."""
    out = faces
    for i in range(3):
        out = out.join(vertices.select("shape_id", F.col("vid").alias(f"i{i}"), *(F.col(c).alias(f"{c}{i}") for c in AXES)), ["shape_id", f"i{i}"])
    return out


def _edge(a: int, b: int) -> list[Column]:
    return [F.col(f"{c}{b}") - F.col(f"{c}{a}") for c in AXES]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def triangle_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, fid, area)."""
    n = _cross(_edge(0, 1), _edge(0, 2))
    return corners(vertices, faces).select("shape_id", "fid", (F.sqrt(_dot(n, n)) / 2).alias("area"))


def surface_area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return triangle_areas(vertices, faces).groupBy("shape_id").agg(F.sum("area").alias("area"))


def vertex_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Barycentric areas (shape_id, vid, area): a third of each face at each corner; the lumped mass."""
    a = triangle_areas(vertices, faces).join(faces, ["shape_id", "fid"])
    return a.select("shape_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), (F.col("area") / 3).alias("a")).groupBy("shape_id", "vid").agg(F.sum("a").alias("area"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, vid, nx, ny, nz): area-weighted, of length 1."""
    n = _cross(_edge(0, 1), _edge(0, 2))
    rows = corners(vertices, faces).select("shape_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *(x.alias(f"n{c}") for x, c in zip(n, AXES, strict=True)))
    total = rows.groupBy("shape_id", "vid").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in AXES))
    length = F.greatest(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.lit(1e-12))
    return total.select("shape_id", "vid", *((F.col(f"n{c}") / length).alias(f"n{c}") for c in AXES))


def cotangent_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Stiffness entries (shape_id, i, j, w), diagonal included: off-diagonal minus half the cotangents opposite the edge, rows sum to 0."""
    n = _cross(_edge(0, 1), _edge(0, 2))
    double_area = F.greatest(F.sqrt(_dot(n, n)), F.lit(1e-20))
    opposite = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
    entries = F.array(*(F.struct(F.col(f"i{a}").alias("i"), F.col(f"i{b}").alias("j"), (-_dot(_edge(o, p), _edge(o, q)) / double_area / 2).alias("w")) for o, p, q in opposite for a, b in ((p, q), (q, p))))
    off = corners(vertices, faces).select("shape_id", F.explode(entries).alias("e")).groupBy("shape_id", "e.i", "e.j").agg(F.sum("e.w").alias("w"))
    diagonal = off.groupBy("shape_id", "i").agg((-F.sum("w")).alias("w")).select("shape_id", "i", F.col("i").alias("j"), "w")
    return off.unionByName(diagonal)


def gaussian_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, vid, curvature): angle defect over barycentric area."""
    def angle(o: int, p: int, q: int) -> Column:
        u, v = _edge(o, p), _edge(o, q)
        c = _dot(u, v) / F.greatest(F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v)), F.lit(1e-20))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))

    at = F.array(*(F.struct(F.col(f"i{o}").alias("vid"), angle(o, p, q).alias("angle")) for o, p, q in ((0, 1, 2), (1, 2, 0), (2, 0, 1))))
    sums = corners(vertices, faces).select("shape_id", F.explode(at).alias("e")).groupBy("shape_id", "e.vid").agg(F.sum("e.angle").alias("angle"))
    return sums.join(vertex_areas(vertices, faces), ["shape_id", "vid"]).select("shape_id", "vid", ((2 * F.pi() - F.col("angle")) / F.greatest("area", F.lit(1e-20))).alias("curvature"))


def mean_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, vid, curvature): half the length of the Laplacian of the coordinates over the mass; unsigned."""
    at = vertices.select("shape_id", F.col("vid").alias("j"), *AXES)
    sums = cotangent_laplacian(vertices, faces).join(at, ["shape_id", "j"]).groupBy("shape_id", F.col("i").alias("vid")).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in AXES))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return sums.join(vertex_areas(vertices, faces), ["shape_id", "vid"]).select("shape_id", "vid", (length / F.greatest("area", F.lit(1e-20)) / 2).alias("curvature"))


def curvatures(vertices: DataFrame, faces: DataFrame, signed: bool = False) -> DataFrame:
    """(shape_id, vid, h, k, k1, k2, shape_index, curvedness, willmore): the family that mean (h) and Gaussian (k) curvature give.

    k1 >= k2 are the principal curvatures, the root kept at 0 where rounding
    makes h*h < k.  The shape index is Koenderink's, within -1 and 1, and 0 on
    flat spots; an umbilic has the sign of h.  ``signed`` gives h the sign of the
    Laplacian against the normal: positive where the surface bends towards
    its normal's back, as a sphere's does.
    """
    h = mean_curvature(vertices, faces)
    if signed:
        at = vertices.select("shape_id", F.col("vid").alias("j"), *AXES)
        pull = cotangent_laplacian(vertices, faces).join(at, ["shape_id", "j"]).groupBy("shape_id", F.col("i").alias("vid")).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in AXES))
        side = pull.join(vertex_normals(vertices, faces), ["shape_id", "vid"]).select("shape_id", "vid", F.signum(sum((F.col(c) * F.col(f"n{c}") for c in AXES), F.lit(0.0))).alias("side"))
        h = h.join(side, ["shape_id", "vid"]).select("shape_id", "vid", (F.col("curvature") * F.when(F.col("side") < 0, -1.0).otherwise(1.0)).alias("curvature"))
    both = h.select("shape_id", "vid", F.col("curvature").alias("h")).join(gaussian_curvature(vertices, faces).withColumnRenamed("curvature", "k"), ["shape_id", "vid"])
    root = F.sqrt(F.greatest(F.col("h") * F.col("h") - F.col("k"), F.lit(0.0)))
    both = both.withColumn("k1", F.col("h") + root).withColumn("k2", F.col("h") - root)
    index = F.when((F.col("k1") == 0) & (F.col("k2") == 0), 0.0).otherwise(2 / F.pi() * F.atan2(F.col("k1") + F.col("k2"), F.col("k1") - F.col("k2")))
    return both.withColumns({"shape_index": index, "curvedness": F.sqrt((F.col("k1") * F.col("k1") + F.col("k2") * F.col("k2")) / 2), "willmore": F.col("h") * F.col("h")})


def willmore_energy(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, energy): the squared mean curvature summed over the vertices' areas."""
    h = mean_curvature(vertices, faces).join(vertex_areas(vertices, faces), ["shape_id", "vid"])
    return h.groupBy("shape_id").agg(F.sum(F.col("curvature") * F.col("curvature") * F.col("area")).alias("energy"))


def voronoi_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, vid, area): mixed Voronoi areas.

    A corner of a face without an obtuse angle gets its part of the Voronoi
    cell; in an obtuse face the obtuse corner gets half and the others a
    quarter each.  They sum to the surface's area, as the barycentric ones do.
    """
    n = _cross(_edge(0, 1), _edge(0, 2))
    double_area = F.greatest(F.sqrt(_dot(n, n)), F.lit(1e-20))
    dots = [_dot(_edge(o, p), _edge(o, q)) for o, p, q in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    squares = [_dot(_edge(a, b), _edge(a, b)) for a, b in ((1, 2), (2, 0), (0, 1))]  # opposite corner 0, 1, 2
    obtuse = functools.reduce(lambda a, b: a | b, (d < 0 for d in dots))

    def part(o: int) -> Column:
        p, q = (o + 1) % 3, (o + 2) % 3
        cell = (squares[p] * dots[p] + squares[q] * dots[q]) / double_area / 8
        return F.when(obtuse, F.when(dots[o] < 0, double_area / 4).otherwise(double_area / 8)).otherwise(cell)

    at = F.array(*(F.struct(F.col(f"i{o}").alias("vid"), part(o).alias("a")) for o in range(3)))
    return corners(vertices, faces).select("shape_id", F.explode(at).alias("e")).groupBy("shape_id", "e.vid").agg(F.sum("e.a").alias("area"))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (shape_id, u, v, n): u < v, and in how many faces."""
    pairs = F.array(*(F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))))
    return faces.select("shape_id", F.explode(pairs).alias("e")).groupBy("shape_id", "e.u", "e.v").agg(F.count("*").alias("n"))


def topology(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, v, e, f, euler, genus, boundary_edges, closed)."""
    e = edges(faces).groupBy("shape_id").agg(F.count("*").alias("e"), F.count_if(F.col("n") == 1).alias("boundary_edges"))
    counts = vertices.groupBy("shape_id").agg(F.count("*").alias("v")).join(e, "shape_id").join(faces.groupBy("shape_id").agg(F.count("*").alias("f")), "shape_id")
    euler = F.col("v") - F.col("e") + F.col("f")
    return counts.select("shape_id", "v", "e", "f", euler.alias("euler"), F.floor((2 - euler) / 2).alias("genus"), "boundary_edges", (F.col("boundary_edges") == 0).alias("closed"))


def edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, u, v, length)."""
    out = edges(faces)
    for end in ("u", "v"):
        out = out.join(vertices.select("shape_id", F.col("vid").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in AXES)), ["shape_id", end])
    d = [F.col(f"{c}_u") - F.col(f"{c}_v") for c in AXES]
    return out.select("shape_id", "u", "v", F.sqrt(_dot(d, d)).alias("length"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    """(shape_id, vid): ends of the edges that only one face has."""
    rim = edges(faces).where("n = 1")
    return rim.select("shape_id", F.explode(F.array("u", "v")).alias("vid")).distinct()


def quality_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row a shape: topology, area, extremes, mean and population deviation of the edge lengths, valences and the number of boundary vertices."""
    lengths = edge_lengths(vertices, faces).groupBy("shape_id").agg(F.min("length").alias("edge_min"), F.avg("length").alias("edge_mean"), F.max("length").alias("edge_max"), F.stddev_pop("length").alias("edge_std"))
    degrees = valence(vertices, faces).groupBy("shape_id").agg(F.min("valence").alias("valence_min"), F.avg("valence").alias("valence_mean"), F.max("valence").alias("valence_max"))
    rim = boundary_vertices(faces).groupBy("shape_id").agg(F.count("*").alias("boundary_vertices"))
    out = topology(vertices, faces)
    for part in (surface_area(vertices, faces), lengths, degrees, rim):
        out = out.join(part, "shape_id", "left")
    return out.fillna(0, ["boundary_vertices"])


def _both_ways(faces: DataFrame) -> DataFrame:
    e = edges(faces)
    return e.select("shape_id", F.col("u").alias("vid"), F.col("v").alias("to")).unionByName(e.select("shape_id", F.col("v").alias("vid"), F.col("u").alias("to")))


def valence(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, vid, valence); 0 for vertices without edges."""
    n = _both_ways(faces).groupBy("shape_id", "vid").agg(F.count("*").alias("n"))
    return vertices.select("shape_id", "vid").join(n, ["shape_id", "vid"], "left").select("shape_id", "vid", F.coalesce("n", F.lit(0)).alias("valence"))


def laplacian_step(vertices: DataFrame, faces: DataFrame, factor: float = 0.5) -> DataFrame:
    """Vertices moved by ``factor`` towards the mean of their neighbours; without neighbours, towards the origin of none: they stay."""
    near = _both_ways(faces).join(vertices.select("shape_id", F.col("vid").alias("to"), *AXES), ["shape_id", "to"]).groupBy("shape_id", "vid").agg(*(F.avg(c).alias(f"m{c}") for c in AXES))
    return vertices.join(near, ["shape_id", "vid"], "left").select("shape_id", "vid", *((F.col(c) + factor * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in AXES))


def taubin_smooth(vertices: DataFrame, faces: DataFrame, iterations: int = 10, lambda_: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Alternating steps of lambda_ and mu."""
    for _ in range(iterations):
        vertices = laplacian_step(laplacian_step(vertices, faces, lambda_), faces, mu)
    return vertices


def torus(spark, n: int = 40, m: int = 20, major: float = 40.0, minor: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a closed torus, generated by the cluster."""
    at = spark.range(n * m).select(F.lit("torus").alias("shape_id"), F.col("id").alias("vid"), F.floor(F.col("id") / m).alias("a"), (F.col("id") % m).alias("b"))
    u, v = 2 * F.pi() * F.col("a") / n, 2 * F.pi() * F.col("b") / m
    vertices = at.select("shape_id", "vid", ((major + minor * F.cos(v)) * F.cos(u)).alias("x"), ((major + minor * F.cos(v)) * F.sin(u)).alias("y"), (minor * F.sin(v)).alias("z"))
    p, q, r, s = F.col("vid"), (F.col("a") + 1) % n * m + F.col("b"), (F.col("a") + 1) % n * m + (F.col("b") + 1) % m, F.col("a") * m + (F.col("b") + 1) % m
    face = lambda i, x, y, z: F.struct((2 * F.col("vid") + i).alias("fid"), x.cast("long").alias("i0"), y.cast("long").alias("i1"), z.cast("long").alias("i2"))
    faces = at.select("shape_id", F.explode(F.array(face(0, p, q, r), face(1, p, r, s))).alias("f")).select("shape_id", "f.*")
    return vertices, faces
