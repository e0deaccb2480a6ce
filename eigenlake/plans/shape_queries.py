"""Queries for clouds, kernels, clusters, tests and resampling, beside those of ``queries``; QUERIES and ORACLES have both."""

from __future__ import annotations

from pyspark.sql import functions as F

from eigenlake.operators import bayes, cloud, cluster, eigen, geometry, harmonise, inference, resample, spectral
from eigenlake.plans.queries import EIG, MAPS, MESH, ORACLES, PTS, QUERIES, eigenpairs, maps, points, query, rounded, table, terrain, trade
from eigenlake.sources import formats

__all__ = ["ORACLES", "QUERIES"]

# ---- clouds

NEAR = f"{PTS}, n AS (SELECT a.shape_id, a.vid, b.vid AS \"to\", sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, row_number() OVER (PARTITION BY a.vid ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), b.vid) - 1 AS rank FROM p a JOIN p b USING (shape_id))"


@query(f'{NEAR} SELECT shape_id, vid, rank::INT AS rank, "to", round(d, 6) + 0.0 AS distance FROM n WHERE rank < 5')
def knn_search(spark, sf_dir):
    return rounded(cloud.knn_search(points(spark, sf_dir), 5), "distance")


@query(f"{NEAR} SELECT shape_id, vid, count(*) AS n, round(sum(d), 6) + 0.0 AS total FROM n WHERE d <= 0.1 GROUP BY ALL")
def radius_search(spark, sf_dir):
    return rounded(cloud.radius_search(points(spark, sf_dir), 0.1).groupBy("shape_id", "vid").agg(F.count("*").alias("n"), F.sum("distance").alias("total")), "total")


@query(f'{NEAR}, e AS (SELECT shape_id, vid AS i, "to" AS j FROM n WHERE rank < 5), b AS (SELECT * FROM e UNION SELECT shape_id, j, i FROM e) SELECT shape_id, i, count(*) AS degree FROM b GROUP BY ALL')
def knn_adjacency(spark, sf_dir):
    return cloud.knn_adjacency(points(spark, sf_dir), 5).groupBy("shape_id", "i").agg(F.count("*").alias("degree"))


DENSITY = f"{NEAR}, k AS (SELECT shape_id, vid, ln(6 / (4.0::DOUBLE / 3 * pi() * pow(greatest(max(d), 1e-12), 3))) AS l FROM n WHERE rank < 6 GROUP BY ALL)"


@query(f"{DENSITY} SELECT shape_id, vid, round(l, 6) + 0.0 AS log_density FROM k")
def point_density(spark, sf_dir):
    return rounded(cloud.density(points(spark, sf_dir)).select("shape_id", "vid", F.log("density").alias("log_density")), "log_density")


@query(f"{DENSITY}, z AS (SELECT shape_id, vid, (l - avg(l) OVER w) / (stddev_pop(l) OVER w + 1e-30) AS z FROM k WINDOW w AS (PARTITION BY shape_id)) SELECT shape_id, vid, round(z, 6) + 0.0 AS z, abs(z) > 2 AS outlier FROM z")
def density_outliers(spark, sf_dir):
    return rounded(cloud.density_outliers(points(spark, sf_dir), 6, 2.0), "z")


@query(f"""{PTS}, q AS (SELECT (shape_id + 9) % 10 AS shape_id, vid, x, y, z FROM p),
 d AS (SELECT a.shape_id, a.vid AS v, b.vid AS w, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d FROM p a JOIN q b ON a.shape_id = b.shape_id),
 a AS (SELECT shape_id, max(m) AS m, avg(m) AS c FROM (SELECT shape_id, v, min(d) AS m FROM d GROUP BY ALL) GROUP BY 1),
 b AS (SELECT shape_id, max(m) AS m, avg(m) AS c FROM (SELECT shape_id, w, min(d) AS m FROM d GROUP BY ALL) GROUP BY 1)
 SELECT shape_id, round(sqrt(greatest(a.m, b.m)), 6) + 0.0 AS hausdorff, round(sqrt(a.m), 6) + 0.0 AS hausdorff_ab, round(a.c + b.c, 6) + 0.0 AS chamfer FROM a JOIN b USING (shape_id)""")
def cloud_distances(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(cloud.cloud_distances(p, p.withColumn("shape_id", ((F.col("shape_id") + 9) % 10).cast("int"))), "hausdorff", "hausdorff_ab", "chamfer")


@query(f"{PTS} SELECT shape_id, count(*) AS n, round(covar_samp(x, x), 6) + 0.0 AS xx, round(covar_samp(x, y), 6) + 0.0 AS xy, round(covar_samp(y, z), 6) + 0.0 AS yz FROM p GROUP BY 1")
def point_covariance(spark, sf_dir):
    return rounded(cloud.covariance(points(spark, sf_dir)).select("shape_id", "n", "xx", "xy", "yz"), "xx", "xy", "yz")


@query()
def pca_axes(spark, sf_dir):
    return cloud.pca_axes(points(spark, sf_dir))


@query()
def align_to_pca(spark, sf_dir):
    return cloud.align_to_pca(points(spark, sf_dir))


@query()
def procrustes(spark, sf_dir):
    p = points(spark, sf_dir)
    return cloud.procrustes(p, p.select("shape_id", "vid", F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z")))


@query()
def farthest_point_sampling(spark, sf_dir):
    return cloud.farthest_points(points(spark, sf_dir), 10)


@query()
def point_normals(spark, sf_dir):
    return cloud.normals(points(spark, sf_dir))


@query()
def local_curvature(spark, sf_dir):
    return cloud.local_curvature(points(spark, sf_dir))


@query()
def cloud_spectrum(spark, sf_dir):
    return eigen.decompose_cloud(cloud.knn_laplacian(points(spark, sf_dir), 10), 10)


# ---- meshes


def _mesh_eig(spark, sf_dir, k):
    v, f = terrain(spark, sf_dir)
    return eigen.decompose(geometry.cotangent_laplacian(v, f), geometry.vertex_areas(v, f), k)


@query()
def mesh_spectrum(spark, sf_dir):
    return _mesh_eig(spark, sf_dir, 20)


@query()
def mesh_hks(spark, sf_dir):
    return spectral.hks(_mesh_eig(spark, sf_dir, 20), n_times=10)


@query()
def spectral_qc(spark, sf_dir):
    return eigen.spectral_qc(_mesh_eig(spark, sf_dir, 20), geometry.vertex_areas(*terrain(spark, sf_dir)))


@query(f"""{MESH.replace('WITH a AS', 'WITH RECURSIVE a AS', 1)}, w AS (SELECT u, e.v, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM e JOIN v p ON p.vid = u JOIN v q ON q.vid = e.v),
 s AS (SELECT u AS a, v AS b, d FROM w UNION ALL SELECT v, u, d FROM w),
 r AS (SELECT vid, 0.0::DOUBLE AS d, 0 AS step FROM v WHERE vid % 512 = 0 UNION ALL SELECT vid, min(d) AS d, min(step) AS step FROM (SELECT s.b AS vid, r.d + s.d AS d, r.step + 1 AS step FROM r JOIN s ON s.a = r.vid WHERE r.step < 60) GROUP BY vid)
 SELECT vid, round(min(d), 6) + 0.0 AS distance FROM r GROUP BY vid""")
def geodesic_dijkstra(spark, sf_dir):
    return rounded(eigen.geodesic_dijkstra(geometry.edge_lengths(*terrain(spark, sf_dir)), lambda vid: vid % 512 == 0).select("vid", "distance"), "distance")


@query()
def geodesic_heat(spark, sf_dir):
    return eigen.geodesic_heat(*terrain(spark, sf_dir), lambda vid: vid % 512 == 0)


@query()
def anisotropic_laplacian(spark, sf_dir):
    return eigen.anisotropic_laplacian(*terrain(spark, sf_dir), 0.5)


@query()
def sgw_transform(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return eigen.sgw_transform(geometry.cotangent_laplacian(v, f), v.select("shape_id", "vid", F.col("z").alias("value")), [0.1, 1.0])


@query(f"{MESH}, m2 AS (SELECT vid FROM v WHERE x > 4) SELECT fid, i0, i1, i2 FROM f WHERE i0 IN (FROM m2) AND i1 IN (FROM m2) AND i2 IN (FROM m2)")
def extract_submesh(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return formats.extract_submesh(v, f, v.where("x > 4"))[1].select("fid", "i0", "i1", "i2")


@query()
def encode_mesh_ply(spark, sf_dir):
    return formats.encode_meshes(*terrain(spark, sf_dir), "ply")


@query("SELECT p_brand AS shape_id, p_size AS label, count(*) AS n, round(avg(p_retailprice), 6) + 0.0 AS mean, round(median(p_retailprice), 6) + 0.0 AS median, round(stddev_pop(p_retailprice), 6) + 0.0 AS std, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) + 0.0 AS iqr FROM part GROUP BY ALL")
def aggregate_by_parcellation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("shape_id"), F.col("p_partkey").alias("vid"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("label"))
    out = formats.aggregate_by_parcel(p.drop("label"), p.drop("value")).select("shape_id", "label", "n", "mean", "median", "std", "iqr")
    return rounded(out, "mean", "median", "std", "iqr")


@query("SELECT n_name AS name, CASE WHEN contains(lower(n_name), 'an') THEN 'x' WHEN contains(lower(n_name), 'i') THEN 'y' ELSE 'unmapped' END AS grp FROM nation")
def remap_parcellation(spark, sf_dir):
    return formats.remap_parcels(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), {"an": "x", "i": "y"}, "contains")


# ---- vectors as descriptors


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.lit("e").alias("shape_id"), F.col("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("f"), "label")


def _patches(spark, sf_dir):
    """The same in shapes of 512 vectors, so that a task's distances are bounded."""
    return _rows(spark, sf_dir).withColumn("shape_id", F.floor(F.col("vid") / 512))


def _means(spark, sf_dir):
    at = _rows(spark, sf_dir).select("label", F.posexplode("f").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return at.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))


MEAN = "WITH c AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS c FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL)"
_RDM = {
    "correlation": "1 - corr(a.c, b.c)",
    "euclidean": "sqrt(sum(pow(a.c - b.c, 2)))",
    "cosine": "1 - sum(a.c * b.c) / greatest(sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)), 1e-30)",
}


def _rdm(metric):
    return lambda spark, sf_dir: rounded(inference.rdm(_means(spark, sf_dir).select(F.col("label").alias("id"), F.col("c").alias("f")), metric), "d")


for _metric, _sql in _RDM.items():
    QUERIES[f"rdm_{_metric}"] = _rdm(_metric)
    ORACLES[f"rdm_{_metric}"] = f"{MEAN} SELECT a.label AS a, b.label AS b, round({_sql}, 6) + 0.0 AS d FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY ALL"


@query(f"{MEAN}, d AS (SELECT a.label AS a, b.label AS b, {_RDM['euclidean']} AS x, {_RDM['correlation']} AS y FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY ALL), r AS (SELECT rank() OVER (ORDER BY x) AS x, rank() OVER (ORDER BY y) AS y FROM d) SELECT round(corr(x, y), 6) + 0.0 AS r, count(*) AS n FROM r")
def rsa_compare(spark, sf_dir):
    m = _means(spark, sf_dir).select(F.col("label").alias("id"), F.col("c").alias("f"))
    return rounded(inference.rsa_compare(inference.rdm(m, "euclidean"), inference.rdm(m, "correlation")), "r")


@query()
def mantel_test(spark, sf_dir):
    m = _means(spark, sf_dir).select(F.col("label").alias("id"), F.col("c").alias("f"))
    return inference.mantel_test(inference.rdm(m, "euclidean"), inference.rdm(m, "correlation"), 1000)


@query(f"{MEAN}, d AS (SELECT e.label AS shape_id, vec_id, c.label AS word, sum(pow(e.embedding[k]::DOUBLE - c, 2)) AS d FROM embeddings e, c GROUP BY ALL), n AS (SELECT shape_id, arg_min(word, (d, word)) AS word FROM d GROUP BY shape_id, vec_id), s AS (SELECT shape_id, word, count(*)::DOUBLE AS n FROM n GROUP BY shape_id, word) SELECT shape_id, word, round(n / sum(n) OVER (PARTITION BY shape_id), 6) + 0.0 AS share FROM s")
def bag_of_spectral_words(spark, sf_dir):
    d = _rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", "f")
    return rounded(inference.bag_of_words(d, _means(spark, sf_dir).select(F.col("label").alias("word"), "c")), "share")


@query()
def fisher_vector(spark, sf_dir):
    d = _rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", "f")
    return inference.fisher_vector(d, *cluster.gmm_codebook(d, 4))


@query()
def kernel_mean_embedding(spark, sf_dir):
    return inference.kernel_mean_embedding(_rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", "f"), 1.0)


@query("WITH l AS (SELECT vec_id AS vid, k, ln(abs(embedding[k]::DOUBLE) + 1e-12) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k) i) SELECT vid, (k - 1)::INT AS k, round(x / (sum(abs(x)) OVER (PARTITION BY vid) + 1e-30), 6) + 0.0 AS value FROM l")
def descriptor_log_l1(spark, sf_dir):
    d = _rows(spark, sf_dir).withColumn("f", F.transform("f", F.abs))
    return rounded(cluster.log_l1(d).select("vid", F.posexplode("f").alias("k", "value")), "value")


@query(f"""{MEAN}, x AS (SELECT vec_id, label, k, embedding[k]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k) i),
 g AS (SELECT k, avg(x) AS g FROM x GROUP BY 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
 b AS (SELECT sum(n * pow(c - g, 2)) AS b FROM c JOIN g USING (k) JOIN n USING (label)),
 r AS (SELECT label, vec_id, sum(pow(x - c, 2)) AS d FROM x JOIN c USING (label, k) GROUP BY ALL), s AS (SELECT label, avg(sqrt(d)) AS s, sum(d) AS w FROM r GROUP BY 1),
 m AS (SELECT p.label AS a, q.label AS b, sqrt(sum(pow(p.c - q.c, 2))) AS m FROM c p JOIN c q ON p.k = q.k AND p.label <> q.label GROUP BY ALL),
 t AS (SELECT a, max((p.s + q.s) / m) AS r FROM m JOIN s p ON p.label = a JOIN s q ON q.label = m.b GROUP BY 1)
 SELECT (SELECT count(*) FROM n) AS clusters, round(b / ((SELECT count(*) FROM n) - 1) / ((SELECT sum(w) FROM s) / ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM n))), 6) + 0.0 AS calinski_harabasz, round((SELECT avg(r) FROM t), 6) + 0.0 AS davies_bouldin FROM b""")
def cluster_quality(spark, sf_dir):
    return rounded(cluster.quality(_rows(spark, sf_dir)).drop("shape_id"), "calinski_harabasz", "davies_bouldin")


PATCHES = "WITH x AS (SELECT vec_id // 512 AS shape_id, vec_id AS vid, label, embedding::DOUBLE[] AS f FROM embeddings), p AS (SELECT a.shape_id, a.vid AS u, b.vid AS v, a.label AS lu, b.label AS lv, list_distance(a.f, b.f) AS d FROM x a JOIN x b ON a.shape_id = b.shape_id)"


@query(f"""{PATCHES}, n AS (SELECT shape_id, label, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT shape_id, u, lu, lv, sum(d) AS d FROM p GROUP BY ALL),
 s AS (SELECT m.shape_id, u, max(m.d / greatest(n - 1, 1)) FILTER (lu = lv) AS a, min(m.d / n) FILTER (lu <> lv) AS b, max(n) FILTER (lu = lv) AS own FROM m JOIN n ON n.shape_id = m.shape_id AND n.label = lv GROUP BY ALL)
 SELECT shape_id, round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) + 0.0 AS silhouette FROM s GROUP BY 1""")
def silhouette(spark, sf_dir):
    return rounded(cluster.silhouette(_patches(spark, sf_dir)), "silhouette")


@query("""WITH b AS (SELECT label AS a, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
 x AS (SELECT sum(n) AS n FROM c GROUP BY a), y AS (SELECT sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS l FROM c),
 u AS (SELECT sum(n * (n - 1) / 2) AS pa, sum(n * ln(n)) AS la FROM x), w AS (SELECT sum(n * (n - 1) / 2) AS pb, sum(n * ln(n)) AS lb FROM y),
 h AS (SELECT *, ln(t) - la / t AS ha, ln(t) - lb / t AS hb, ln(t) - l / t AS hab, pa * pb / (t * (t - 1) / 2) AS e FROM t, u, w)
 SELECT round((p - e) / ((pa + pb) / 2 - e), 6) + 0.0 AS ari, round((ha + hb - hab) / ha, 6) + 0.0 AS homogeneity, round((ha + hb - hab) / hb, 6) + 0.0 AS completeness, round(2 * (ha + hb - hab) / (ha + hb), 6) + 0.0 AS nmi FROM h""")
def cluster_comparison(spark, sf_dir):
    r = _rows(spark, sf_dir)
    other = r.select("shape_id", "vid", ((F.get("f", F.lit(0)) > 0).cast("int") + 2 * (F.get("f", F.lit(1)) > 0).cast("int")).alias("label"))
    return rounded(cluster.comparison(r, other).select("ari", "homogeneity", "completeness", "nmi"), "ari", "homogeneity", "completeness", "nmi")


@query()
def cluster_kmeans(spark, sf_dir):
    return cluster.kmeans(_rows(spark, sf_dir), 6)


@query()
def cluster_spectral(spark, sf_dir):
    return cluster.spectral_clusters(_patches(spark, sf_dir), 6)


@query(f"""{PATCHES.replace('WITH x', 'WITH RECURSIVE x', 1)}, near AS (SELECT shape_id, u, v FROM p WHERE d <= 1.2), core AS (SELECT u FROM near GROUP BY u HAVING count(*) >= 5),
 r AS (SELECT u AS vid, u AS root FROM core UNION SELECT near.v, r.root FROM r JOIN near ON near.u = r.vid WHERE near.v IN (FROM core)),
 c AS (SELECT vid, min(root) AS root FROM r GROUP BY 1),
 e AS (SELECT x.shape_id, x.vid, coalesce(c.root, (SELECT min(q.root) FROM near JOIN c q ON q.vid = near.v WHERE near.u = x.vid)) AS root FROM x LEFT JOIN c USING (vid))
 SELECT shape_id, vid, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY shape_id ORDER BY root NULLS LAST) - 1 END::INT AS label FROM e""")
def cluster_dbscan(spark, sf_dir):
    return cluster.dbscan(_patches(spark, sf_dir), 1.2, 5)


@query()
def cluster_mixture(spark, sf_dir):
    return cluster.mixture(_rows(spark, sf_dir), 5)


@query()
def cluster_temporal_fpca(spark, sf_dir):
    return cluster.temporal_fpca(_rows(spark, sf_dir))


@query()
def spectral_pca(spark, sf_dir):
    return cluster.spectral_pca(_rows(spark, sf_dir))


@query()
def cluster_gnmf(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    d = v.select("shape_id", "vid", F.array(F.abs("x"), F.abs("y"), F.abs("z")).alias("f"))
    return cluster.gnmf(d, geometry.edges(f), 3)


@query()
def cluster_persistence(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return cluster.persistence(v.select("shape_id", "vid", F.col("x").alias("value")), geometry.edges(f))


@query()
def cluster_stdbscan(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return cluster.st_dbscan(v.select("shape_id", "vid", F.array("x", "y", "z").alias("f")), geometry.edges(f))


@query(f"{MESH}, near AS (SELECT a, max(z) AS o FROM (SELECT u AS a, v.z FROM e JOIN v ON v.vid = e.v UNION ALL SELECT e.v, v.z FROM e JOIN v ON v.vid = e.u) GROUP BY a) SELECT vid, round(z, 6) + 0.0 AS value FROM v JOIN near ON a = vid WHERE round(z, 9) > round(o, 9)")
def cluster_scalespace_blobs(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    field = v.select("shape_id", "vid", F.lit(0).alias("t"), F.lit(1.0).alias("time"), F.round("z", 9).alias("value"))
    return rounded(cluster.scalespace_blobs(field, geometry.edges(f)).select("vid", "value"), "value")


@query()
def cluster_mapper(spark, sf_dir):
    return cluster.mapper(_patches(spark, sf_dir), eps=1.2)[0]


# ---- cohorts


#: Tails by Simpson's rule over 2000 steps, and their Benjamini-Hochberg correction.
TAILS = """simpson AS (SELECT i / 2000.0::DOUBLE AS share, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 6000.0::DOUBLE AS weight FROM range(0, 2001) r(i)),
 corrected AS (SELECT *, least(min(p * n / k) OVER (ORDER BY p DESC, vid DESC ROWS UNBOUNDED PRECEDING), 1) AS p_corrected FROM (SELECT *, row_number() OVER (ORDER BY p, vid) AS k, count(*) OVER () AS n FROM tails))"""
_STUDENT = "t AS (SELECT vid, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM d), tails AS (SELECT vid, t, greatest(1 - 2 * any_value(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())) * abs(t) * sum(weight * pow(1 + pow(share * t, 2) / df, -(df + 1) / 2)), 0) AS p FROM t, simpson GROUP BY vid, t)"
_RANKSUM = """r AS (SELECT vid, grp, value, rank() OVER (PARTITION BY vid ORDER BY value) + (count(*) OVER (PARTITION BY vid, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY vid, value) AS c FROM maps),
 u AS (SELECT vid, sum(r) FILTER (grp = 'A') - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2.0::DOUBLE AS u, count(*) FILTER (grp = 'A')::DOUBLE AS na, count(*) FILTER (grp = 'R')::DOUBLE AS nb, sum(c::DOUBLE * c - 1) AS ties FROM r GROUP BY 1),
 z AS (SELECT vid, u, greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS z FROM u),
 tails AS (SELECT vid, u, z, greatest(1 - 2 / sqrt(2 * pi()) * z * sum(weight * exp(-pow(share * z, 2) / 2)), 0) AS p FROM z, simpson GROUP BY vid, u, z)"""


def _with_tails(cte):
    simpson, _, corrected = TAILS.partition(",\n corrected")
    return f"{MAPS}, {simpson}, {cte},\n corrected{corrected}"


@query(f"{_with_tails(_STUDENT)} SELECT vid, round(t, 6) + 0.0 AS t, round(p, 5) + 0.0 AS p, round(p_corrected, 5) + 0.0 AS p_corrected, p_corrected < 0.05 AS significant FROM corrected")
def vertexwise_ttest(spark, sf_dir):
    out = inference.vertexwise_ttest(maps(spark, sf_dir), "A", "R").select("vid", "t", "p", "p_corrected", "significant")
    return rounded(rounded(out, "t"), "p", "p_corrected", digits=5)


@query(f"{_with_tails(_RANKSUM)} SELECT vid, round(u, 3) + 0.0 AS u, round(z, 6) + 0.0 AS z, round(p, 5) + 0.0 AS p, round(p_corrected, 5) + 0.0 AS p_corrected, p_corrected < 0.05 AS significant FROM corrected")
def vertexwise_mannwhitney(spark, sf_dir):
    out = inference.vertexwise_mannwhitney(maps(spark, sf_dir), "A", "R").select("vid", "u", "z", "p", "p_corrected", "significant")
    return rounded(rounded(rounded(out, "z"), "u", digits=3), "p", "p_corrected", digits=5)


def _users(spark, sf_dir):
    """Maps user x day, groups by the parity of the user, days without an event at 0."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.dayofmonth("ts").cast("long").alias("vid"), "value")
    every = e.select("subject").distinct().crossJoin(F.broadcast(spark.range(1, 32).withColumnRenamed("id", "vid")))  # the table of the maps itself
    m = every.join(e.groupBy("subject", "vid").agg(F.sum("value").alias("value")), ["subject", "vid"], "left").fillna(0.0, ["value"])
    return m.withColumn("grp", F.when(F.col("subject") % 2 == 0, "a").otherwise("b"))


@query()
def vertexwise_permutation(spark, sf_dir):
    return inference.permutation_test(_users(spark, sf_dir), "a", "b", 1000)


@query()
def vertexwise_correlation(spark, sf_dir):
    m = _users(spark, sf_dir)
    s = m.groupBy("subject").agg(F.max("value").alias("score"), F.avg(F.col("vid") * F.col("value")).alias("c"))
    return inference.vertexwise_correlation(m, s, ["c"])


@query()
def tfce(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return inference.tfce(v.select("shape_id", "vid", F.col("x").alias("value")), geometry.edges(f))


@query("""WITH d AS (SELECT l_linenumber AS feature, l_discount::DOUBLE - l_tax::DOUBLE AS d FROM lineitem WHERE l_discount::DOUBLE - l_tax::DOUBLE <> 0),
 r AS (SELECT feature, d, rank() OVER (PARTITION BY feature ORDER BY abs(d)) + (count(*) OVER (PARTITION BY feature, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, abs(d)) AS t FROM d),
 s AS (SELECT feature, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w, count(*) AS n, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1)
 SELECT feature, w AS w_plus, n, round((w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) + 0.0 AS z FROM s""")
def asymmetry_test(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("feature"), F.col("l_discount").cast("double").alias("left"), F.col("l_tax").cast("double").alias("right"))
    return rounded(inference.asymmetry(p).drop("p"), "z")


@query("WITH f AS (SELECT p_size AS vid, arg_min(p_retailprice, p_partkey) AS x FROM part GROUP BY 1), c AS (SELECT vid, count(*) AS n, count(*) FILTER (p_retailprice < x) AS b, count(*) FILTER (p_retailprice <= x) AS u FROM part JOIN f ON p_size = vid GROUP BY 1) SELECT vid, round(50.0 * (CASE WHEN u > b THEN b + u + 1 ELSE b + u END) / n, 6) + 0.0 AS percentile FROM c")
def surprise_percentile(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = p.groupBy(F.col("p_size").alias("vid")).agg(F.min_by("p_retailprice", "p_partkey").alias("value"))
    return rounded(inference.percentile_score(one, p.select(F.col("p_size").alias("vid"), F.col("p_retailprice").alias("value"))), "percentile")


METRICS = "WITH s AS (SELECT avg(l_discount - l_tax) AS d, stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS se, count(*) - 1 AS df FROM lineitem)"


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("new"), F.col("l_tax").cast("double").alias("ref"))


@query(f"{METRICS} SELECT round(d, 6) + 0.0 AS difference, round(se, 6) + 0.0 AS se, df::DOUBLE AS df, round((d + 0.05) / se, 3) + 0.0 AS t, round(d - 1.959963984540054 * se, 6) + 0.0 AS lower FROM s")
def non_inferiority(spark, sf_dir):
    return rounded(rounded(inference.non_inferiority(_metrics(spark, sf_dir)).drop("p"), "difference", "se", "lower"), "t", digits=3)


@query(f"{METRICS} SELECT round(d, 6) + 0.0 AS difference, round((d + 0.05) / se, 3) + 0.0 AS t_lower, round((d - 0.05) / se, 3) + 0.0 AS t_upper FROM s")
def equivalence_tost(spark, sf_dir):
    return rounded(rounded(inference.equivalence_tost(_metrics(spark, sf_dir)).drop("p"), "difference"), "t_lower", "t_upper", digits=3)


@query()
def bootstrap_ci(spark, sf_dir):
    return resample.bootstrap_mean(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), 1000, method="bca")


@query()
def null_spin(spark, sf_dir):
    v, _ = resample.uv_sphere(spark, 10, 20)
    return resample.null_spin(v.withColumn("value", F.col("z")), 10)


@query()
def null_edge_rewiring(spark, sf_dir):
    edges, _ = trade(spark, sf_dir)
    e = edges.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("w").alias("w"))
    return resample.null_rewired(e, 5)


@query()
def null_labels(spark, sf_dir):
    return resample.null_labels(_users(spark, sf_dir).select("subject", F.col("grp").alias("label")).distinct(), 20)


@query()
def null_phase(spark, sf_dir):
    c = eigenpairs(spark, sf_dir).select("shape_id", F.posexplode("phi").alias("k", "p")).groupBy("shape_id", "k").agg(F.sum("p").alias("c"))
    return resample.null_phase(c, eigenpairs(spark, sf_dir), 3)


@query(f"{EIG}, s AS (SELECT l, sum(l) OVER (ORDER BY k) / sum(l) OVER () AS share, k FROM (SELECT DISTINCT k, l FROM x)) SELECT (min(k) FILTER (share >= 0.95))::INT AS k_95, (min(k) FILTER (share >= 0.99))::INT AS k_99, (arg_max(k, (g, -k)) FILTER (g IS NOT NULL))::INT AS k_gap FROM (SELECT *, round(lead(l) OVER (ORDER BY k) - l, 9) AS g FROM s) WHERE g IS NOT NULL OR share >= 0.95")
def optimal_k(spark, sf_dir):
    return harmonise.optimal_k(eigenpairs(spark, sf_dir)).select("k_95", "k_99", "k_gap")


@query()
def combat_covariates(spark, sf_dir):
    rows, covariates = _sites(spark, sf_dir)
    return harmonise.combat(rows, covariates)


@query()
def combat_gam(spark, sf_dir):
    rows, covariates = _sites(spark, sf_dir)
    return harmonise.combat_gam(rows, covariates, "age")


def _sites(spark, sf_dir):
    """Customers as subjects, nations as sites, mean price by order priority as features; the balance is a covariate."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("site"), F.col("o_orderpriority").alias("feature")).agg(F.avg("o_totalprice").alias("value"))
    return rows, c.select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("age"))


@query()
def horseshoe_regression(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return bayes.horseshoe(p.select(F.array(F.col("p_size").cast("double") / 50, (F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 11).cast("double")).alias("x"), (F.col("p_retailprice") / 1000).cast("double").alias("y")), draws=500, tune=200)


@query()
def best_comparison(spark, sf_dir):
    return bayes.best(_users(spark, sf_dir).groupBy("subject", "grp").agg((F.sum("value") / 1000).alias("value")), "a", "b", draws=500, tune=200)


@query()
def gp_normative(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("age")).agg(F.avg("p_retailprice").alias("value"))
    return bayes.gp_normative(p)
