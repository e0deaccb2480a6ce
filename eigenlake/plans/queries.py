"""Queries over the driver's tables for the operators, each with SQL of its own for DuckDB.

Rows of ``embeddings`` stand for vertices whose entries are eigenvectors, with
eigenvalue 0.1 k (k+1) for the k-th; the first three entries are also read as
points of a cloud, one cloud a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenlake.functions import names
from eigenlake.operators import cohort, distribution, geometry, network, spectral
from eigenlake.operators.order import small

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names_: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero made zero, so that sums in another order compare equal."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names_})


# ---- eigenpairs

K = 64
EIG = "WITH eig AS (SELECT vec_id AS vid, embedding::DOUBLE[] AS phi FROM embeddings), idx AS (SELECT unnest(range(1, 65)) AS k), x AS (SELECT vid, k, phi[k] AS p, 0.1 * (k - 1) * k AS l FROM eig, idx)"


def eigenpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.lit(0.1) * k * (k + 1))
    return table(spark, sf_dir, "embeddings").select(F.lit("e").alias("shape_id"), F.col("vec_id").alias("vid"), lam.alias("lam"), F.col("embedding").cast("array<double>").alias("phi"))


TIMES = "t AS (SELECT i AS t, pow(10, log10(4 * ln(10) / 403.2) + (log10(4 * ln(10) / 0.2) - log10(4 * ln(10) / 403.2)) * i / 9) AS time FROM range(0, 10) r(i))"


@query(f"{EIG}, {TIMES} SELECT vid, t::INT AS t, round(sum(exp(-l * time) * p * p), 6) + 0.0 AS hks FROM x, t GROUP BY vid, t")
def hks(spark, sf_dir):
    return rounded(spectral.hks(eigenpairs(spark, sf_dir), n_times=10).select("vid", "t", "hks"), "hks")


@query(f"{EIG}, {TIMES}, h AS (SELECT vid, t, sum(exp(-l * time) * p * p) AS h FROM x, t GROUP BY vid, t) SELECT vid, t::INT AS t, round(h / sqrt(sum(h * h) OVER (PARTITION BY t)), 6) + 0.0 AS hks FROM h")
def hks_normalized(spark, sf_dir):
    return rounded(spectral.hks(eigenpairs(spark, sf_dir), n_times=10, normalize=True).select("vid", "t", "hks"), "hks")


@query(f"""{EIG}, e AS (SELECT i AS e, -1.0 + 0.7 * i AS energy FROM range(0, 10) r(i)),
 g AS (SELECT e, k, exp(-pow(energy - ln(0.1 * (k - 1) * k), 2) / 0.98) AS g FROM e, idx WHERE k > 1),
 n AS (SELECT e, k, g / sum(g) OVER (PARTITION BY e) AS g FROM g),
 w AS (SELECT vid, e, sum(p * p * g) AS w FROM x JOIN n USING (k) GROUP BY vid, e)
 SELECT vid, e::INT AS e, round(w / sqrt(sum(w * w) OVER (PARTITION BY e)), 6) + 0.0 AS wks FROM w""")
def wks(spark, sf_dir):
    return rounded(spectral.wks(eigenpairs(spark, sf_dir), [-1.0 + 0.7 * i for i in range(10)], 0.7).select("vid", "e", "wks"), "wks")


@query(f"{EIG} SELECT vid, (k - 1)::INT AS k, round(p / sqrt(l), 6) + 0.0 AS gps FROM x WHERE k > 1")
def gps(spark, sf_dir):
    out = spectral.gps(eigenpairs(spark, sf_dir)).select("vid", F.posexplode("gps").alias("k", "gps")).withColumn("k", F.col("k") + 1)
    return rounded(out, "gps")


@query(f"{EIG} SELECT vid, round(sum(p * p / (l * l)), 6) + 0.0 AS bks FROM x WHERE k > 1 GROUP BY vid")
def bks(spark, sf_dir):
    return rounded(spectral.bks(eigenpairs(spark, sf_dir)).select("vid", "bks"), "bks")


@query(f"""{EIG}, {TIMES}, s AS (SELECT vid, t, sum(exp(-l * time) * p) AS a, sum(pow(exp(-l * time) * p, 2)) AS b, sum(pow(exp(-l * time) * p, 3)) AS c FROM x, t GROUP BY vid, t)
 SELECT vid, t::INT AS t, round(a, 6) + 0.0 AS e1, round((a * a - b) / 2, 6) + 0.0 AS e2, round((a * a * a - 3 * a * b + 2 * c) / 6, 6) + 0.0 AS e3 FROM s""")
def bates(spark, sf_dir):
    return rounded(spectral.bates(eigenpairs(spark, sf_dir), n_times=10).select("vid", "t", "e1", "e2", "e3"), "e1", "e2", "e3")


@query(f"""{EIG}, {TIMES}, h AS (SELECT vid, t, ln(greatest(sum(exp(-l * time) * p * p), 1e-30)) AS h FROM x, t GROUP BY vid, t),
 d AS (SELECT vid, t - 1 AS i, h - lag(h) OVER (PARTITION BY vid ORDER BY t) AS d FROM h), f AS (SELECT unnest(range(1, 5)) AS f)
 SELECT vid, f::INT AS f, round(sqrt(pow(sum(d * cos(2 * pi() * f * i / 9)), 2) + pow(sum(d * sin(2 * pi() * f * i / 9)), 2)), 6) + 0.0 AS value FROM d, f WHERE d IS NOT NULL GROUP BY vid, f""")
def si_hks(spark, sf_dir):
    return rounded(spectral.si_hks(eigenpairs(spark, sf_dir), n_times=10, n_frequencies=4).select("vid", "f", "value"), "value")


def _wavelet(kernel: str):
    return lambda spark, sf_dir: rounded(spectral.wavelet_descriptor(eigenpairs(spark, sf_dir), [0.01, 0.1, 1.0], kernel).select("vid", "s", "value"), "value")


for _kernel, _sql in (("mexican_hat", "y * exp(-y)"), ("heat", "exp(-y)"), ("band", "CASE WHEN y > 0.5 AND y < 2 THEN sin(pi() * (y - 0.5) / 1.5) ELSE 0 END")):
    QUERIES[f"wavelet_{_kernel}"] = _wavelet(_kernel)
    ORACLES[f"wavelet_{_kernel}"] = f"{EIG}, s AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.1::DOUBLE), (2, 1.0::DOUBLE)) v(s, scale)), y AS (SELECT vid, s, p, l * scale AS y FROM x, s) SELECT vid, s::INT AS s, round(sum(pow(({_sql}) * p, 2)), 6) + 0.0 AS value FROM y GROUP BY vid, s"


def _landmarks(spark, sf_dir):
    """The first vertex of each label."""
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("phi"))
    return small(first.select(F.lit("e").alias("shape_id"), F.col("label").alias("to"), F.col("phi").cast("array<double>").alias("phi_to")))


def _distance(kind: str):
    return lambda spark, sf_dir: rounded(spectral.distance_to(eigenpairs(spark, sf_dir), _landmarks(spark, sf_dir), kind, 0.1).select("vid", "to", "distance"), "distance")


for _kind, _weight in (("biharmonic", "CASE WHEN x.k > 1 THEN 1 / (x.l * x.l) ELSE 0 END"), ("commute", "CASE WHEN x.k > 1 THEN 1 / x.l ELSE 0 END"), ("diffusion", "exp(-0.2 * x.l)")):
    QUERIES[f"{_kind}_distance"] = _distance(_kind)
    ORACLES[f"{_kind}_distance"] = f'{EIG}, m AS (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY label), y AS (SELECT label AS "to", k, p FROM m JOIN x ON x.vid = m.v) SELECT x.vid, y."to", round(sqrt(sum(({_weight}) * pow(x.p - y.p, 2))), 6) + 0.0 AS distance FROM x JOIN y USING (k) GROUP BY x.vid, y."to"'


@query(f"{EIG} SELECT (a.k - 1)::INT AS i, (b.k - 1)::INT AS j, round(sum(a.p * b.p), 6) + 0.0 AS dot FROM x a JOIN x b ON a.vid = b.vid AND a.k <= b.k GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    return rounded(spectral.qc_orthonormality(eigenpairs(spark, sf_dir)).select("i", "j", "dot"), "dot")


DNA = "WITH d AS (SELECT c_nationkey AS shape_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS k, avg(abs(c_acctbal)) / 1000 AS value FROM customer GROUP BY ALL)"


def _dna(spark, sf_dir):
    seg = F.col("c_mktsegment")
    k = F.when(seg == "AUTOMOBILE", 1).when(seg == "BUILDING", 2).when(seg == "FURNITURE", 3).when(seg == "HOUSEHOLD", 4).otherwise(5)
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("shape_id"), k.alias("k")).agg((F.avg(F.abs("c_acctbal")) / 1000).alias("value"))


@query(f"{DNA}, w AS (SELECT a.shape_id AS a, b.shape_id AS b, sqrt(sum(pow(abs(a.value - b.value) / greatest(a.value * b.value, 1e-20), 2))) AS w FROM d a JOIN d b ON a.k = b.k AND a.shape_id < b.shape_id GROUP BY ALL) SELECT a, b, round(w / (1 + w), 6) + 0.0 AS distance FROM w")
def wesd(spark, sf_dir):
    return rounded(spectral.wesd(_dna(spark, sf_dir)), "distance")


@query(f"{DNA} SELECT k, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, round(stddev_pop(value) / (abs(avg(value)) + 1e-30), 6) + 0.0 AS cv FROM d GROUP BY k")
def eigenvalue_stability(spark, sf_dir):
    return rounded(cohort.stability(_dna(spark, sf_dir), "k", "value"), "mean", "std", "cv")


# ---- points and meshes

PTS = "WITH p AS (SELECT label AS shape_id, vec_id AS vid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("shape_id"), F.col("vec_id").alias("vid"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


@query(f"{PTS} SELECT shape_id, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz FROM p GROUP BY 1")
def centroid(spark, sf_dir):
    return rounded(geometry.centroid(points(spark, sf_dir)), "cx", "cy", "cz")


@query(f"{PTS} SELECT shape_id, round(min(x), 6) + 0.0 AS min_x, round(max(x), 6) + 0.0 AS max_x, round(max(x) - min(x), 6) + 0.0 AS extent_x, round(max(y) - min(y), 6) + 0.0 AS extent_y, round(max(z) - min(z), 6) + 0.0 AS extent_z FROM p GROUP BY 1")
def bounding_box(spark, sf_dir):
    out = geometry.bounding_box(points(spark, sf_dir)).select("shape_id", "min_x", "max_x", "extent_x", "extent_y", "extent_z")
    return rounded(out, "min_x", "max_x", "extent_x", "extent_y", "extent_z")


@query(f"{PTS}, c AS (SELECT shape_id, avg(x) AS a, avg(y) AS b, avg(z) AS c, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS f FROM p GROUP BY 1) SELECT shape_id, vid, round((x - a) / f, 6) + 0.0 AS x, round((y - b) / f, 6) + 0.0 AS y, round((z - c) / f, 6) + 0.0 AS z FROM p JOIN c USING (shape_id)")
def normalize_scale(spark, sf_dir):
    return rounded(geometry.normalize_scale(points(spark, sf_dir)).drop("factor"), "x", "y", "z")


MESH = """WITH a AS (SELECT vec_id AS vid, vec_id // 512 AS shape_id, vec_id % 16 AS c, vec_id // 16 AS r, 10 * list_avg(embedding::DOUBLE[]) AS z FROM embeddings WHERE embedding IS NOT NULL),
 v AS (SELECT vid, shape_id, c::DOUBLE AS x, r::DOUBLE AS y, z FROM a),
 q AS (SELECT vid AS p, vid + 1 AS q, vid + 17 AS r, vid + 16 AS s FROM a WHERE c < 15 AND (vid + 16) // 512 = shape_id AND vid + 1 IN (SELECT vid FROM a) AND vid + 16 IN (SELECT vid FROM a) AND vid + 17 IN (SELECT vid FROM a)),
 f AS (SELECT 2 * p AS fid, p AS i0, q AS i1, r AS i2 FROM q UNION ALL SELECT 2 * p + 1, p, r, s FROM q),
 h AS (SELECT fid, unnest([i0, i1, i2]) AS o, unnest([i1, i2, i0]) AS p, unnest([i2, i0, i1]) AS q FROM f),
 g AS (SELECT fid, o, p, q, a.x - c.x AS ux, a.y - c.y AS uy, a.z - c.z AS uz, b.x - c.x AS wx, b.y - c.y AS wy, b.z - c.z AS wz FROM h JOIN v c ON c.vid = o JOIN v a ON a.vid = p JOIN v b ON b.vid = q),
 n AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz, ux * wx + uy * wy + uz * wz AS dot FROM g),
 m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS dbl FROM n),
 area AS (SELECT o AS vid, sum(dbl / 6) AS area FROM m GROUP BY 1),
 off AS (SELECT i, j, sum(w) AS w FROM (SELECT p AS i, q AS j, -dot / dbl / 2 AS w FROM m UNION ALL SELECT q, p, -dot / dbl / 2 FROM m) GROUP BY 1, 2),
 e AS (SELECT DISTINCT least(p, q) AS u, greatest(p, q) AS v FROM h)"""


def terrain(spark, sf_dir):
    """Vertices and faces of height fields: a vertex a vector, 16 in a row and 512 in a shape, as high as ten times the vector's mean; a cell without all its corners has no faces."""
    at = table(spark, sf_dir, "embeddings").where("embedding is not null")
    total = F.aggregate(F.filter("embedding", lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double"))
    z = 10 * total / F.size(F.filter("embedding", lambda x: x.isNotNull()))
    shape = lambda i: F.floor(i / 512)
    vertices = at.select(shape(F.col("vec_id")).alias("shape_id"), F.col("vec_id").alias("vid"), (F.col("vec_id") % 16).cast("double").alias("x"), F.floor(F.col("vec_id") / 16).cast("double").alias("y"), z.alias("z"))
    cells = at.select("vec_id").where((F.col("vec_id") % 16 < 15) & (shape(F.col("vec_id")) == shape(F.col("vec_id") + 16)))
    for step in (1, 16, 17):
        cells = cells.join(at.select((F.col("vec_id") - step).alias("vec_id")), "vec_id", "left_semi")
    p = F.col("vec_id")
    face = lambda i, a, b, c: F.struct((2 * p + i).alias("fid"), a.alias("i0"), b.alias("i1"), c.alias("i2"))
    faces = cells.select(shape(p).alias("shape_id"), F.explode(F.array(face(0, p, p + 1, p + 17), face(1, p, p + 17, p + 16))).alias("f")).select("shape_id", "f.*")
    return vertices, faces


@query(f"{MESH} SELECT fid, round(any_value(dbl) / 2, 6) + 0.0 AS area FROM m GROUP BY fid")
def triangle_areas(spark, sf_dir):
    return rounded(geometry.triangle_areas(*terrain(spark, sf_dir)).drop("shape_id"), "area")


@query(f"{MESH} SELECT vid, round(area, 6) + 0.0 AS area FROM area")
def vertex_areas(spark, sf_dir):
    return rounded(geometry.vertex_areas(*terrain(spark, sf_dir)).drop("shape_id"), "area")


@query(f"{MESH} SELECT i, j, round(w, 6) + 0.0 AS w FROM off UNION ALL SELECT i, i, round(-sum(w), 6) + 0.0 FROM off GROUP BY i")
def cotangent_laplacian(spark, sf_dir):
    return rounded(geometry.cotangent_laplacian(*terrain(spark, sf_dir)).drop("shape_id"), "w")


@query(f"{MESH} SELECT o AS vid, round((2 * pi() - sum(acos(greatest(-1, least(1, dot / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(wx * wx + wy * wy + wz * wz))))))) / any_value(area), 6) + 0.0 AS curvature FROM m JOIN area ON vid = o GROUP BY o")
def gaussian_curvature(spark, sf_dir):
    return rounded(geometry.gaussian_curvature(*terrain(spark, sf_dir)).drop("shape_id"), "curvature")


@query(f"{MESH}, l AS (SELECT i, j, w FROM off UNION ALL SELECT i, i, -sum(w) FROM off GROUP BY i), s AS (SELECT i, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM l JOIN v ON v.vid = j GROUP BY i) SELECT i AS vid, round(sqrt(x * x + y * y + z * z) / area / 2, 6) + 0.0 AS curvature FROM s JOIN area ON area.vid = i")
def mean_curvature(spark, sf_dir):
    return rounded(geometry.mean_curvature(*terrain(spark, sf_dir)).drop("shape_id"), "curvature")


@query(f"{MESH}, s AS (SELECT o AS vid, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM m GROUP BY 1) SELECT vid, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS nx, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS ny, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS nz FROM s")
def vertex_normals(spark, sf_dir):
    return rounded(geometry.vertex_normals(*terrain(spark, sf_dir)).drop("shape_id"), "nx", "ny", "nz")


TOPOLOGY = f"""{MESH}, en AS (SELECT least(p, q) AS u, greatest(p, q) AS v, count(*) AS n FROM h GROUP BY ALL),
 et AS (SELECT shape_id, count(*) AS e, count(*) FILTER (n = 1) AS boundary_edges FROM en JOIN v ON v.vid = u GROUP BY 1),
 tp AS (SELECT shape_id, v, e, f, v - e + f AS euler, floor((2 - (v - e + f)) / 2)::BIGINT AS genus, boundary_edges, boundary_edges = 0 AS closed
  FROM (SELECT shape_id, count(*) AS v FROM v GROUP BY 1) JOIN et USING (shape_id) JOIN (SELECT shape_id, count(*) AS f FROM f JOIN v ON vid = i0 GROUP BY 1) USING (shape_id))"""


@query(f"{TOPOLOGY} SELECT * FROM tp")
def mesh_topology(spark, sf_dir):
    return geometry.topology(*terrain(spark, sf_dir))


@query(f"{MESH} SELECT u, e.v, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) + 0.0 AS length FROM e JOIN v a ON a.vid = u JOIN v b ON b.vid = e.v")
def edge_lengths(spark, sf_dir):
    return rounded(geometry.edge_lengths(*terrain(spark, sf_dir)).drop("shape_id"), "length")


@query(f"{MESH} SELECT vid, count(*) AS valence FROM (SELECT u AS vid FROM e UNION ALL SELECT v FROM e) GROUP BY 1")
def vertex_valence(spark, sf_dir):
    return geometry.valence(*terrain(spark, sf_dir)).drop("shape_id")


@query(f"{MESH}, t AS (SELECT u AS vid, v AS o FROM e UNION ALL SELECT v, u FROM e), c AS (SELECT t.vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM t JOIN v ON v.vid = o GROUP BY 1) SELECT vid, round((v.x + c.x) / 2, 6) + 0.0 AS x, round((v.y + c.y) / 2, 6) + 0.0 AS y, round((v.z + c.z) / 2, 6) + 0.0 AS z FROM v JOIN c USING (vid)")
def laplacian_smooth(spark, sf_dir):
    vertices, faces = terrain(spark, sf_dir)
    return rounded(geometry.laplacian_step(vertices, faces).drop("shape_id"), "x", "y", "z")


CURVATURE = f"""{MESH}, l AS (SELECT i, j, w FROM off UNION ALL SELECT i, i, -sum(w) FROM off GROUP BY i),
 hm AS (SELECT i AS vid, sqrt(pow(sum(w * x), 2) + pow(sum(w * y), 2) + pow(sum(w * z), 2)) / any_value(area) / 2 AS h FROM l JOIN v ON v.vid = j JOIN area ON area.vid = i GROUP BY i),
 kg AS (SELECT o AS vid, (2 * pi() - sum(acos(greatest(-1, least(1, dot / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(wx * wx + wy * wy + wz * wz))))))) / any_value(area) AS k FROM m JOIN area ON vid = o GROUP BY o),
 cv AS (SELECT vid, h, k, h + sqrt(greatest(h * h - k, 0)) AS k1, h - sqrt(greatest(h * h - k, 0)) AS k2 FROM hm JOIN kg USING (vid))"""


@query(f"{CURVATURE} SELECT vid, round(h, 6) + 0.0 AS h, round(k, 6) + 0.0 AS k, round(k1, 6) + 0.0 AS k1, round(k2, 6) + 0.0 AS k2, round(2 / pi() * atan2(k1 + k2, k1 - k2), 6) + 0.0 AS shape_index, round(sqrt((k1 * k1 + k2 * k2) / 2), 6) + 0.0 AS curvedness, round(h * h, 6) + 0.0 AS willmore FROM cv")
def curvature_family(spark, sf_dir):
    out = geometry.curvatures(*terrain(spark, sf_dir)).drop("shape_id")
    return rounded(out, "h", "k", "k1", "k2", "shape_index", "curvedness", "willmore")


@query(f"{CURVATURE} SELECT shape_id, round(sum(h * h * area), 6) + 0.0 AS energy FROM cv JOIN area USING (vid) JOIN v USING (vid) GROUP BY shape_id")
def willmore_energy(spark, sf_dir):
    return rounded(geometry.willmore_energy(*terrain(spark, sf_dir)), "energy")


@query(f"""{MESH}, c AS (SELECT fid, o, dot, dbl, pow(ux - wx, 2) + pow(uy - wy, 2) + pow(uz - wz, 2) AS across, min(dot) OVER (PARTITION BY fid) < 0 AS obtuse FROM m),
 s AS (SELECT *, sum(across * dot) OVER (PARTITION BY fid) - across * dot AS others FROM c)
 SELECT o AS vid, round(sum(CASE WHEN obtuse AND dot < 0 THEN dbl / 4 WHEN obtuse THEN dbl / 8 ELSE others / dbl / 8 END), 6) + 0.0 AS area FROM s GROUP BY o""")
def voronoi_areas(spark, sf_dir):
    return rounded(geometry.voronoi_areas(*terrain(spark, sf_dir)).drop("shape_id"), "area")


@query(f"{TOPOLOGY} SELECT DISTINCT unnest([u, v]) AS vid FROM en WHERE n = 1")
def boundary_vertices(spark, sf_dir):
    return geometry.boundary_vertices(terrain(spark, sf_dir)[1]).select("vid")


@query(f"""{TOPOLOGY}, el AS (SELECT a.shape_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM e JOIN v a ON a.vid = u JOIN v b ON b.vid = e.v),
 le AS (SELECT shape_id, round(min(d), 6) + 0.0 AS edge_min, round(avg(d), 6) + 0.0 AS edge_mean, round(max(d), 6) + 0.0 AS edge_max, round(stddev_pop(d), 6) + 0.0 AS edge_std FROM el GROUP BY 1),
 va AS (SELECT shape_id, min(n) AS valence_min, round(avg(n), 6) + 0.0 AS valence_mean, max(n) AS valence_max FROM (SELECT shape_id, vid, count(u) AS n FROM v LEFT JOIN (SELECT u FROM e UNION ALL SELECT e.v FROM e) x ON u = vid GROUP BY ALL) GROUP BY 1),
 bd AS (SELECT shape_id, count(DISTINCT vid) AS boundary_vertices FROM (SELECT unnest([u, v]) AS vid FROM en WHERE n = 1) JOIN v USING (vid) GROUP BY 1),
 sa AS (SELECT shape_id, round(sum(dbl) / 6, 6) + 0.0 AS area FROM m JOIN v ON vid = o GROUP BY 1)
 SELECT tp.*, area, edge_min, edge_mean, edge_max, edge_std, valence_min, valence_mean, valence_max, coalesce(boundary_vertices, 0) AS boundary_vertices FROM tp LEFT JOIN sa USING (shape_id) LEFT JOIN le USING (shape_id) LEFT JOIN va USING (shape_id) LEFT JOIN bd USING (shape_id)""")
def quality_report(spark, sf_dir):
    return rounded(geometry.quality_report(*terrain(spark, sf_dir)), "area", "edge_min", "edge_mean", "edge_max", "edge_std", "valence_mean")


# ---- cohorts

MAPS = "WITH maps AS (SELECT l_returnflag AS grp, l_linenumber AS vid, l_extendedprice AS value FROM lineitem WHERE l_returnflag IN ('A', 'R')), s AS (SELECT vid, count(*) FILTER (grp = 'A')::DOUBLE AS na, avg(value) FILTER (grp = 'A') AS ma, var_samp(value) FILTER (grp = 'A') AS va, count(*) FILTER (grp = 'R')::DOUBLE AS nb, avg(value) FILTER (grp = 'R') AS mb, var_samp(value) FILTER (grp = 'R') AS vb FROM maps GROUP BY 1), d AS (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS pool FROM s)"


def maps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("vid"), F.col("l_extendedprice").alias("value"))


@query(f"{MAPS} SELECT vid, round((ma - mb) / sqrt(va / na + vb / nb), 6) + 0.0 AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 3) + 0.0 AS df, round((ma - mb) / sqrt(pool), 6) + 0.0 AS cohens_d, round((ma - mb) / sqrt(pool) * (1 - 3 / (4 * (na + nb - 2) - 1)), 6) + 0.0 AS hedges_g FROM d")
def welch_ttest(spark, sf_dir):
    return rounded(rounded(cohort.ttest(maps(spark, sf_dir), "A", "R"), "t", "cohens_d", "hedges_g"), "df", digits=3)


@query(f"{MAPS} SELECT vid, round((ma - mb) / sqrt(pool * (1 / na + 1 / nb)), 6) + 0.0 AS t, (na + nb - 2)::DOUBLE AS df FROM d")
def pooled_ttest(spark, sf_dir):
    return rounded(cohort.ttest(maps(spark, sf_dir), "A", "R", pooled=True).select("vid", "t", "df"), "t")


@query(f"{MAPS}, r AS (SELECT vid, grp, rank() OVER (PARTITION BY vid ORDER BY value) + (count(*) OVER (PARTITION BY vid, value) - 1) / 2.0::DOUBLE AS r FROM maps) SELECT vid, round(sum(r) FILTER (grp = 'A') - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2, 3) + 0.0 AS u FROM r GROUP BY vid")
def mann_whitney(spark, sf_dir):
    return rounded(cohort.mannwhitney(maps(spark, sf_dir), "A", "R"), "u", digits=3)


@query("WITH p AS (SELECT s_nationkey AS fam, s_suppkey AS id, abs(s_acctbal) / 20000 AS p FROM supplier), r AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, id) AS q, count(*) OVER (PARTITION BY fam) AS n FROM p) SELECT fam, id, round(p, 9) + 0.0 AS p, round(least(min(q) OVER (PARTITION BY fam ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING), 1), 6) + 0.0 AS p_fdr, round(least(p * n, 1), 6) + 0.0 AS p_bonferroni FROM r")
def fdr_correction(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("fam"), F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 20000).alias("p"))
    return rounded(rounded(cohort.benjamini_hochberg(p, "fam"), "p_fdr", "p_bonferroni"), "p", digits=9)


XYZ = "WITH r AS (SELECT l_linenumber AS vid, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"


def _xyz(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("vid"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


@query(f"{XYZ}, c AS (SELECT vid, corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c, count(*) AS n FROM r GROUP BY 1) SELECT vid, round(a, 6) + 0.0 AS r, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) + 0.0 AS partial_r, n FROM c")
def partial_correlation(spark, sf_dir):
    return rounded(cohort.partial_correlation(_xyz(spark, sf_dir), "vid"), "r", "partial_r")


@query(f"{XYZ}, k AS (SELECT vid, rank() OVER (PARTITION BY vid ORDER BY x) + (count(*) OVER (PARTITION BY vid, x) - 1) / 2 AS a, rank() OVER (PARTITION BY vid ORDER BY y) + (count(*) OVER (PARTITION BY vid, y) - 1) / 2 AS b FROM r) SELECT vid, round(corr(a, b), 6) + 0.0 AS rho FROM k GROUP BY 1")
def spearman_correlation(spark, sf_dir):
    return rounded(cohort.spearman(_xyz(spark, sf_dir), "vid"), "rho")


@query("""WITH s AS (SELECT l_linenumber AS vid, count(*) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
 z AS (SELECT vid, (l_quantity - mean) / std AS z FROM lineitem JOIN s ON vid = l_linenumber)
 SELECT vid, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, lo AS "min", hi AS "max", q1, median, q3, round(sk, 6) + 0.0 AS skewness, round(ku, 6) + 0.0 AS kurtosis, outliers FROM s JOIN (SELECT vid, avg(pow(z, 3)) AS sk, avg(pow(z, 4)) - 3 AS ku, count(*) FILTER (abs(z) > 3) AS outliers FROM z GROUP BY 1) USING (vid)""")
def descriptor_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("vid"), F.col("l_quantity").alias("value"))
    return rounded(cohort.profile(rows, "value", "vid"), "mean", "std", "skewness", "kurtosis")


@query("""WITH r AS (SELECT c_nationkey AS site, o_orderpriority AS feature, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey),
 big AS (SELECT feature, site FROM r GROUP BY ALL HAVING count(*) > 1),
 k AS (SELECT feature, site, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM r JOIN big USING (feature, site)),
 g AS (SELECT feature, site, sum(r) AS s, count(*)::DOUBLE AS m FROM k GROUP BY ALL), t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM k GROUP BY ALL) GROUP BY 1),
 h AS (SELECT feature, sum(s * s / m) AS s, sum(m) AS n, count(*) AS groups FROM g GROUP BY 1)
 SELECT feature, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) + 0.0 AS h, groups, n::BIGINT AS n FROM h JOIN t USING (feature)""")
def batch_effect_scan(spark, sf_dir):
    return rounded(cohort.kruskal(_sites(spark, sf_dir), "site", "value", "feature"), "h", digits=4)


def _sites(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("site"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("subject"), "site", F.col("o_orderpriority").alias("feature"), F.col("o_totalprice").alias("value"))


@query("""WITH r AS (SELECT o_orderkey AS subject, c_nationkey AS site, o_orderpriority AS feature, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey),
 a AS (SELECT feature, site, avg(value) AS mu, var_pop(value) AS vp, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
 b AS (SELECT feature, avg(mu) AS grand, sqrt(sum(vp * n) / sum(n)) AS sd FROM a GROUP BY 1),
 c AS (SELECT a.*, grand, sd, (mu - grand) / sd AS g, CASE WHEN n > 1 THEN vp * n / (n - 1) ELSE 0 END / (sd * sd) AS d FROM a JOIN b USING (feature)),
 p AS (SELECT feature, avg(g) AS gb, var_samp(g) AS tau, avg(d) AS dm, var_samp(d) AS dv FROM c GROUP BY 1),
 e AS (SELECT feature, site, grand, sd, (n * tau * g + d * gb) / (n * tau + d) AS gs, ((dm * dv + dm * dm * dm) / dv + n * d / 2) / ((2 * dv + dm * dm) / dv + n / 2 + 1) AS ds FROM c JOIN p USING (feature))
 SELECT subject, site, feature, value, round(((value - grand) / sd - gs) / sqrt(ds) * sd + grand, 4) + 0.0 AS harmonised FROM r JOIN e USING (feature, site)""")
def combat(spark, sf_dir):
    return rounded(cohort.combat(_sites(spark, sf_dir)), "harmonised", digits=4)


@query("""WITH r AS (SELECT p_brand AS grp, p_partkey AS id, p_size::DOUBLE AS age, p_retailprice AS value FROM part),
 m AS (SELECT grp, regr_slope(value, age) AS b, regr_intercept(value, age) AS a, sqrt(greatest((regr_syy(value, age) - regr_slope(value, age) * regr_sxy(value, age)) / (count(*) - 2), 0)) AS s FROM r GROUP BY 1),
 z AS (SELECT grp, id, value, a + b * age AS expected, (value - a - b * age) / (s + 1e-30) AS z FROM r JOIN m USING (grp))
 SELECT grp, id, value, round(expected, 4) + 0.0 AS expected, round(z, 4) + 0.0 AS z, (CASE WHEN z > 2 THEN 1 WHEN z < -2 THEN -1 ELSE 0 END)::INT AS extreme FROM z""")
def normative_model(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("age"), F.col("p_retailprice").alias("value"))
    return rounded(cohort.normative(rows, "grp"), "expected", "z", digits=4)


@query("SELECT floor(p_size / 10)::BIGINT AS bin, count(*) AS n, round(quantile_cont(p_retailprice, 0.05), 6) + 0.0 AS p5, round(quantile_cont(p_retailprice, 0.25), 6) + 0.0 AS p25, round(quantile_cont(p_retailprice, 0.5), 6) + 0.0 AS p50, round(quantile_cont(p_retailprice, 0.75), 6) + 0.0 AS p75, round(quantile_cont(p_retailprice, 0.95), 6) + 0.0 AS p95, (floor(p_size / 10) + 0.5) * 10.0::DOUBLE AS age FROM part GROUP BY floor(p_size / 10)")
def centile_curves(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("age"), F.col("p_retailprice").alias("value"))
    return rounded(cohort.centile_curves(rows, 10.0), "p5", "p25", "p50", "p75", "p95")


@query("WITH p AS (SELECT l_shipmode_ AS feature, l, r FROM (SELECT l_linenumber AS l_shipmode_, l_quantity AS l, l_extendedprice / 1000 AS r FROM lineitem)) SELECT feature, round(avg((l - r) / (abs(l) + abs(r) + 1e-30)), 6) + 0.0 AS li, round(avg(l - r) / (stddev_samp(l - r) / sqrt(count(*))), 6) + 0.0 AS paired_t FROM p GROUP BY 1")
def lateralisation_index(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("feature"), F.col("l_quantity").alias("left"), (F.col("l_extendedprice") / 1000).alias("right"))
    return rounded(cohort.lateralisation(pairs), "li", "paired_t")


SCORES = "WITH s AS (SELECT toxic AS y, n_chars::DOUBLE AS s_a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS s_b FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"


def _scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s_a"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("double").alias("s_b"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").alias("y"), "s_a", "s_b").where("y is not null")


@query(f"""{SCORES}, r AS (SELECT *, {", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2 - (rank() OVER (PARTITION BY y ORDER BY {s}) + (count(*) OVER (PARTITION BY y, {s}) - 1) / 2) AS d_{s}" for s in ("s_a", "s_b"))}, count(*) FILTER (y = 1) OVER () AS m, count(*) FILTER (y = 0) OVER () AS n FROM s),
 v AS (SELECT y, m, n, CASE WHEN y = 1 THEN d_s_a / n ELSE 1 - d_s_a / m END AS a, CASE WHEN y = 1 THEN d_s_b / n ELSE 1 - d_s_b / m END AS b FROM r),
 g AS (SELECT avg(a) FILTER (y = 1) AS auc_a, avg(b) FILTER (y = 1) AS auc_b, var_samp(a) FILTER (y = 1) / any_value(m) + var_samp(a) FILTER (y = 0) / any_value(n) AS var_a, var_samp(b) FILTER (y = 1) / any_value(m) + var_samp(b) FILTER (y = 0) / any_value(n) AS var_b, covar_samp(a, b) FILTER (y = 1) / any_value(m) + covar_samp(a, b) FILTER (y = 0) / any_value(n) AS cov_ab FROM v)
 SELECT round(auc_a, 6) + 0.0 AS auc_a, round(auc_b, 6) + 0.0 AS auc_b, round(var_a, 9) + 0.0 AS var_a, round(var_b, 9) + 0.0 AS var_b, round(cov_ab, 9) + 0.0 AS cov_ab, round((auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov_ab), 5) + 0.0 AS z FROM g""")
def delong(spark, sf_dir):
    out = rounded(cohort.delong(_scores(spark, sf_dir)), "auc_a", "auc_b")
    return rounded(rounded(out, "var_a", "var_b", "cov_ab", digits=9), "z", digits=5)


@query("""WITH s AS (SELECT log10(n_chars + 1) AS a, log10(length(text) + 2) AS b FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL), t AS (SELECT count(*)::DOUBLE AS n, 2 * var_samp((a + b) / 2) AS r, count(*) * pow(avg(a - b), 2) / 2 AS c, count(*) * avg(pow(a - b, 2)) / 2 AS tot FROM s), u AS (SELECT n, r, c, (tot - c) / (n - 1) AS e FROM t)
 SELECT round((r - e) / (r + e + 2 * (c - e) / n), 6) + 0.0 AS icc_2_1, round((r - e) / (r + e), 6) + 0.0 AS icc_3_1 FROM u""")
def icc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.log10(F.col("n_chars") + 1).alias("a"), F.log10(F.length("text") + 2).alias("b"))
    return rounded(cohort.icc(d, "a", "b"), "icc_2_1", "icc_3_1")


# ---- networks: trade between nations, communities are regions

NET = "WITH t AS (SELECT s_nationkey AS i, c_nationkey AS j, sum(l_extendedprice) / 1000 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL), u AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM t UNION ALL SELECT j, i, w FROM t) GROUP BY ALL), x AS (SELECT i, j, w, a.n_regionkey AS ci, b.n_regionkey AS cj FROM u JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j)"


def trade(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders, customer, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"]).join(supplier, F.col("l_suppkey") == supplier["s_suppkey"])
    edges = rows.groupBy(F.col("s_nationkey").alias("i"), F.col("c_nationkey").alias("j")).agg((F.sum("l_extendedprice") / 1000).alias("w"))
    return edges, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("c"))


@query(f"{NET}, c AS (SELECT ci, sum(w) AS s, sum(w) FILTER (ci = cj) AS n FROM x GROUP BY 1) SELECT round(sum(n) / sum(s) - sum(s * s) / pow(sum(s), 2), 6) + 0.0 AS q FROM c")
def modularity(spark, sf_dir):
    return rounded(network.modularity(*trade(spark, sf_dir)), "q")


@query(f"{NET}, c AS (SELECT i, cj, sum(w) AS s FROM x GROUP BY ALL) SELECT i, round(sum(s), 3) + 0.0 AS strength, round(1 - sum(s * s) / pow(sum(s), 2), 6) + 0.0 AS participation FROM c GROUP BY i")
def participation(spark, sf_dir):
    return rounded(rounded(network.participation(*trade(spark, sf_dir)), "participation"), "strength", digits=3)


@query(f"{NET} SELECT round(avg(w) FILTER (ci = cj), 3) + 0.0 AS intra, round(avg(w) FILTER (ci <> cj), 3) + 0.0 AS inter, round(avg(w) FILTER (ci = cj) / avg(w) FILTER (ci <> cj), 6) + 0.0 AS ratio FROM x")
def intra_inter_ratio(spark, sf_dir):
    return rounded(rounded(network.intra_inter(*trade(spark, sf_dir)), "ratio"), "intra", "inter", digits=3)


@query(f"{NET} SELECT least(ci, cj) AS ci, greatest(ci, cj) AS cj, round(avg(w), 3) + 0.0 AS w, count(*) AS n FROM x WHERE i < j GROUP BY 1, 2")
def aggregate_to_networks(spark, sf_dir):
    return rounded(network.block_means(*trade(spark, sf_dir)), "w", digits=3)


# ---- distributions of values by group

HIST = "WITH v AS (SELECT label AS g, embedding[1]::DOUBLE AS x FROM embeddings WHERE label IN (0, 1)), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)"


def _values(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.get("embedding", F.lit(0)).cast("double").alias("x")).where("g in (0, 1)")


@query(f"""{HIST}, b AS (SELECT g, least(floor((x - lo) / (hi - lo) * 50), 49) AS b FROM v, e), c AS (SELECT k, (count(*) FILTER (g = 0)) AS a, (count(*) FILTER (g = 1)) AS c FROM range(0, 50) r(k) LEFT JOIN b ON b.b = k GROUP BY k),
 p AS (SELECT a / sum(a) OVER () + 1e-10 AS p, c / sum(c) OVER () + 1e-10 AS q FROM c), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM p)
 SELECT round(sum(p * ln(p / q)), 6) + 0.0 AS kl, round((sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2, 6) + 0.0 AS js FROM n""")
def kl_divergence(spark, sf_dir):
    return rounded(distribution.divergences(_values(spark, sf_dir), 0, 1), "kl", "js")


@query(f"{HIST}, s AS (SELECT x, avg(CASE WHEN g = 0 THEN 1.0 ELSE 0 END) AS _, sum((g = 0)::INT) AS a, sum((g = 1)::INT) AS b FROM v GROUP BY x), c AS (SELECT x, sum(a) OVER (ORDER BY x)::DOUBLE / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x)::DOUBLE / sum(b) OVER () AS fb, lead(x) OVER (ORDER BY x) - x AS gap FROM s) SELECT round(sum(abs(fa - fb) * gap), 6) + 0.0 AS distance FROM c")
def wasserstein(spark, sf_dir):
    return rounded(distribution.wasserstein_1d(_values(spark, sf_dir), 0, 1), "distance")


@query(f"{HIST}, p AS (SELECT a.g AS a, b.g AS b, avg(abs(a.x - b.x)) AS d FROM v a, v b GROUP BY ALL) SELECT round(2 * max(d) FILTER (a = 0 AND b = 1) - max(d) FILTER (a = 0 AND b = 0) - max(d) FILTER (a = 1 AND b = 1), 6) + 0.0 AS distance FROM p")
def energy_distance(spark, sf_dir):
    return rounded(distribution.energy_1d(_values(spark, sf_dir), 0, 1), "distance")


# ---- names

@query("SELECT n_nationkey, lower(trim(n_name)) AS name, CASE WHEN regexp_matches(lower(n_name) || '.gii', '\\.(gii|gifti)$') THEN 'gifti' ELSE NULL END AS format FROM nation")
def detect_format(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.lower(F.trim("n_name")).alias("name"), names.geometry_format(F.concat(F.lower("n_name"), F.lit(".gii"))).alias("format"))


@query("SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 4, '0') AS sub, s_nationkey::VARCHAR AS ses, CASE WHEN s_acctbal > 0 THEN 'L' ELSE 'R' END AS hemi FROM supplier")
def parse_bids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("/data/sub-"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit("/anat/sub-x_ses-"), F.col("s_nationkey").cast("string"), F.lit("_hemi-"), F.when(F.col("s_acctbal") > 0, "L").otherwise("R"), F.lit("_thickness.shape.gii"))
    e = names.bids_entities(path)
    return s.select("s_suppkey", F.element_at(e, "sub").alias("sub"), F.element_at(e, "ses").alias("ses"), F.element_at(e, "hemi").alias("hemi"))
