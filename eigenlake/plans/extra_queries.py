"""Queries for comparisons, parcels, densities, labels and classifiers, beside those of ``shape_queries``; QUERIES and ORACLES have all."""

from __future__ import annotations

from pyspark.sql import functions as F

from eigenlake.functions import atlas
from eigenlake.operators import bayes, cluster, compare, density, eigen, figures, geometry, hulls, inference, learn, order, parcels, resample, signals, spectral
from eigenlake.plans.queries import DNA, EIG, MAPS, MESH, PTS, TIMES, _dna, _landmarks, _scores, eigenpairs, maps, points, query, rounded, table, terrain, trade
from eigenlake.plans.shape_queries import MEAN, ORACLES, QUERIES, _means, _rows, _users
from eigenlake.sources import formats, group

__all__ = ["ORACLES", "QUERIES"]

# ---- spectra


def _values(spark, sf_dir):
    return _dna(spark, sf_dir).select("shape_id", (F.col("k") - 1).alias("k"), F.col("value").alias("lambda"), F.lit(2.0).alias("area"), F.lit(8.0).alias("volume"))


@query(f"{DNA}, w AS (SELECT shape_id, max(value) FILTER (k = 2) AS f, max(value) FILTER (k = 3) AS g FROM d GROUP BY 1) SELECT shape_id, round(coalesce(f, 0), 6) + 0.0 AS fiedler, round(coalesce(g - f, 0), 6) + 0.0 AS gap FROM w")
def spectral_gap(spark, sf_dir):
    return rounded(spectral.gaps(_values(spark, sf_dir)), "fiedler", "gap")


@query(f"{DNA} SELECT shape_id, k - 1 AS k, round(value, 6) + 0.0 AS \"lambda\" FROM d WHERE k <= 3 AND shape_id IN (SELECT shape_id FROM d GROUP BY 1 HAVING count(*) >= 3)")
def truncated_spectrum(spark, sf_dir):
    values = _values(spark, sf_dir)
    whole = values.join(values.groupBy("shape_id").agg(F.count("*").alias("n")).where("n >= 3").drop("n"), "shape_id")
    return rounded(spectral.truncated(whole, 3).select("shape_id", "k", "lambda"), "lambda")


for _method, _sql in (("area", "value * 2"), ("volume", "value * 4"), ("fiedler", "value / greatest(coalesce(max(value) FILTER (k = 2) OVER (PARTITION BY shape_id), 0), 1e-30)")):
    QUERIES[f"normalized_values_{_method}"] = lambda spark, sf_dir, m=_method: rounded(spectral.normalized_values(_values(spark, sf_dir), m), "value", digits=4)
    ORACLES[f"normalized_values_{_method}"] = f"{DNA} SELECT shape_id, k - 1 AS k, round({_sql}, 4) + 0.0 AS value FROM d"

for _metric, _sql in (("euclidean", "sqrt(sum(pow(a.value - b.value, 2)))"), ("cosine", "1 - sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value)))")):
    QUERIES[f"shapedna_distance_{_metric}"] = lambda spark, sf_dir, m=_metric: rounded(spectral.shapedna_distance(_dna(spark, sf_dir), m), "distance")
    ORACLES[f"shapedna_distance_{_metric}"] = f"{DNA}, r AS (SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY k) AS k, value FROM d) SELECT a.shape_id AS a, b.shape_id AS b, round({_sql}, 6) + 0.0 AS distance FROM r a JOIN r b ON a.k = b.k AND a.shape_id < b.shape_id GROUP BY ALL"


@query(f"{DNA}, r AS (SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY k) AS k, value FROM d) SELECT a.shape_id AS a, b.shape_id AS b, round(sqrt(sum(pow(a.value - b.value, 2) * a.k)), 6) + 0.0 AS distance FROM r a JOIN r b ON a.k = b.k AND a.shape_id < b.shape_id GROUP BY ALL")
def shapedna_distance_mahalanobis(spark, sf_dir):
    inverse = spark.range(5).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), (F.col("id") + 1).cast("double").alias("w"))
    return rounded(spectral.shapedna_distance(_dna(spark, sf_dir), "mahalanobis", inverse), "distance")


@query(f"""{EIG}, b AS (SELECT vid, sum(p * p / (l * l)) AS b FROM x WHERE k > 1 GROUP BY vid), c AS (SELECT vid, sqrt(sum(l * p * p)) AS c FROM x WHERE k BETWEEN 2 AND 11 GROUP BY vid),
 d AS (SELECT s.vec_id AS vid, t.vec_id AS o, {' + '.join(f'pow(s.embedding[{k}]::DOUBLE - t.embedding[{k}]::DOUBLE, 2)' for k in range(1, 11))} AS d FROM embeddings s JOIN embeddings t ON s.label = t.label),
 n AS (SELECT vid, o FROM (SELECT vid, o, row_number() OVER (PARTITION BY vid ORDER BY d, o) AS i FROM d) WHERE i <= 10),
 m AS (SELECT n.vid, avg(c * b) AS m FROM n JOIN b ON b.vid = o JOIN c ON c.vid = o GROUP BY n.vid)
 SELECT vid, round(b + 0.1 * m, 6) + 0.0 AS ibks FROM b JOIN m USING (vid)""")
def ibks(spark, sf_dir):
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.col("label").alias("shape"))
    eig = eigenpairs(spark, sf_dir).join(label, "vid").select(F.col("shape").alias("shape_id"), "vid", "lam", "phi")
    return rounded(spectral.ibks(eig).select("vid", "ibks"), "ibks")


@query(f"{EIG} SELECT 'e' AS shape_id, round(min(ln(l)) FILTER (k > 1) + 14 * (max(ln(l)) FILTER (k > 1) - min(ln(l)) FILTER (k > 1)) / 100, 6) + 0.0 AS lo, round(max(ln(l)) FILTER (k > 1) - 14 * (max(ln(l)) FILTER (k > 1) - min(ln(l)) FILTER (k > 1)) / 100, 6) + 0.0 AS hi, round(7 * (max(ln(l)) FILTER (k > 1) - min(ln(l)) FILTER (k > 1)) / 100, 6) + 0.0 AS sigma FROM (SELECT k, CASE WHEN k > 1 THEN 0.1 * (k - 1) * k ELSE 1 END AS l FROM idx)")
def wks_settings(spark, sf_dir):
    values = spark.range(64).select(F.lit("e").alias("shape_id"), F.col("id").alias("k"), (F.lit(0.1) * F.col("id") * (F.col("id") + 1)).alias("lambda"))
    return rounded(spectral.wks_settings(values), "lo", "hi", "sigma")


@query(f"""{EIG}, s AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.1::DOUBLE), (2, 1.0::DOUBLE)) v(s, scale)), y AS (SELECT vid, s, p, l * scale AS y FROM x, s),
 z AS (SELECT vid, s, p, y, CASE WHEN y >= 0.5 AND y < 1 THEN 2 * y - 1 WHEN y >= 1 AND y < 2 THEN y - 1 END AS w FROM y),
 g AS (SELECT vid, s, p, CASE WHEN w IS NULL THEN 0 WHEN y < 1 THEN pow(sin(pi() / 2 * (35 * pow(w, 4) - 84 * pow(w, 5) + 70 * pow(w, 6) - 20 * pow(w, 7))), 2) ELSE pow(cos(pi() / 2 * (35 * pow(w, 4) - 84 * pow(w, 5) + 70 * pow(w, 6) - 20 * pow(w, 7))), 2) END AS g FROM z)
 SELECT vid, s::INT AS s, round(sum(pow(g * p, 2)), 6) + 0.0 AS value FROM g GROUP BY ALL""")
def wavelet_meyer(spark, sf_dir):
    return rounded(spectral.wavelet_descriptor(eigenpairs(spark, sf_dir), [0.01, 0.1, 1.0], "meyer").select("vid", "s", "value"), "value")


@query(f"""{EIG}, m AS (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY label), y AS (SELECT label AS "to", k, p FROM m JOIN x ON x.vid = m.v), t AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.1::DOUBLE), (2, 1.0::DOUBLE)) v(t, time))
 SELECT x.vid, y."to", t::INT AS t, round(sqrt(sum(exp(-2 * x.l * time) * pow(x.p - y.p, 2))), 6) + 0.0 AS distance FROM x JOIN y USING (k), t GROUP BY x.vid, y."to", t""")
def diffusion_multiscale(spark, sf_dir):
    return rounded(spectral.diffusion_distances(eigenpairs(spark, sf_dir), _landmarks(spark, sf_dir), [0.01, 0.1, 1.0]).select("vid", "to", "t", "distance"), "distance")


@query(f"""{EIG}, {TIMES}, h AS (SELECT vid, t, sum(exp(-l * time) * p * p) AS h, sum(exp(-l * time) * p) AS a, sum(pow(exp(-l * time) * p, 2)) AS b FROM x, t GROUP BY vid, t)
 SELECT vid, 'hks' AS descriptor, t::INT AS i, round(h, 6) + 0.0 AS value FROM h UNION ALL SELECT vid, 'bates_e1', t::INT, round(a, 6) + 0.0 FROM h UNION ALL SELECT vid, 'bates_e2', t::INT, round((a * a - b) / 2, 6) + 0.0 FROM h
 UNION ALL SELECT vid, 'gps', (k - 2)::INT, round(p / sqrt(l), 6) + 0.0 FROM x WHERE k > 1 UNION ALL SELECT vid, 'bks', 0, round(sum(p * p / (l * l)), 6) + 0.0 FROM x WHERE k > 1 GROUP BY vid""")
def all_descriptors(spark, sf_dir):
    out = spectral.all_descriptors(eigenpairs(spark, sf_dir), n_times=10).where("descriptor in ('hks', 'bates_e1', 'bates_e2', 'gps', 'bks')")
    return rounded(out.drop("shape_id"), "value")


@query()
def anisotropic_hks(spark, sf_dir):
    return eigen.anisotropic_hks(*terrain(spark, sf_dir), k=10, n_times=5)


@query()
def anisotropic_wks(spark, sf_dir):
    return eigen.anisotropic_wks(*terrain(spark, sf_dir), k=10, n_energies=5)


@query()
def anisotropic_wavelets(spark, sf_dir):
    return eigen.anisotropic_wavelets(*terrain(spark, sf_dir), [0.1, 1.0], k=10, n_directions=2)


# ---- parcels and matrices of them


def _parcels(spark, sf_dir):
    return _rows(spark, sf_dir).select("shape_id", F.col("label").cast("long").alias("parcel"), "vid", "f")


PAIRS = "x AS (SELECT label, vec_id, k, embedding[k]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k) i)"


@query(f"""WITH {PAIRS}, n AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1), ab AS (SELECT a.label AS a, b.label AS b FROM n a JOIN n b ON a.label < b.label),
 u AS (SELECT a, b, k, x, CASE WHEN x.label = a THEN 1 / p.n ELSE -1 / q.n END AS s FROM ab JOIN n p ON p.label = a JOIN n q ON q.label = b JOIN x ON x.label = a OR x.label = b),
 v AS (SELECT a, b, k, x, sum(s) AS s FROM u GROUP BY ALL), w AS (SELECT a, b, k, abs(sum(s) OVER w) * (lead(x) OVER w - x) AS d FROM v WINDOW w AS (PARTITION BY a, b, k ORDER BY x ROWS UNBOUNDED PRECEDING))
 SELECT a::BIGINT AS a, b::BIGINT AS b, round(sum(d) / 64, 6) + 0.0 AS d FROM w GROUP BY a, b""")
def connectome_wasserstein(spark, sf_dir):
    return rounded(compare.connectome(_parcels(spark, sf_dir)).select("a", "b", "d"), "d")


@query("""WITH g AS (SELECT a.label AS a, b.label AS b, avg(exp(-(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) / 2)) AS g FROM embeddings a JOIN embeddings b ON a.label <= b.label GROUP BY ALL)
 SELECT p.a::BIGINT AS a, p.b::BIGINT AS b, round(sqrt(greatest(s.g + t.g - 2 * p.g, 0)), 6) + 0.0 AS d FROM g p JOIN g s ON s.a = p.a AND s.b = p.a JOIN g t ON t.a = p.b AND t.b = p.b WHERE p.a < p.b""")
def connectome_mmd(spark, sf_dir):
    return rounded(compare.connectome(_parcels(spark, sf_dir), "mmd", 1.0).select("a", "b", "d"), "d")


for _metric, _sql in (("correlation", "1 - corr(a.c, b.c)"), ("euclidean", "sqrt(sum(pow(a.c - b.c, 2)))"), ("cosine", "1 - sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)))")):
    QUERIES[f"connectome_{_metric}"] = lambda spark, sf_dir, m=_metric: rounded(compare.connectome(_parcels(spark, sf_dir), m).select("a", "b", "d"), "d")
    ORACLES[f"connectome_{_metric}"] = f"{MEAN} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round({_sql}, 6) + 0.0 AS d FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY ALL"


def _vertex_labels(spark, sf_dir):
    return terrain(spark, sf_dir)[0].select("shape_id", "vid", F.when(F.col("z") > 0, 1).when(F.col("z") > -0.2, 2).otherwise(3).alias("label"))


PARCELS = f"""{MESH}, lb AS (SELECT vid, shape_id, x, y, z, CASE WHEN z > 0 THEN 1 WHEN z > -0.2 THEN 2 ELSE 3 END AS label FROM v),
 pf AS (SELECT p.shape_id, p.label, fid FROM f JOIN lb p ON p.vid = i0 JOIN lb q ON q.vid = i1 JOIN lb r ON r.vid = i2 WHERE p.label = q.label AND q.label = r.label AND p.label <> 3),
 fn AS (SELECT shape_id, label, count(*) AS n_faces FROM pf GROUP BY ALL), vn AS (SELECT shape_id, label, count(*) AS n_vertices FROM lb WHERE label <> 3 GROUP BY ALL)"""


@query(f"{PARCELS} SELECT shape_id, label, n_vertices, n_faces FROM fn JOIN vn USING (shape_id, label) WHERE n_vertices >= 3")
def apply_parcellation(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return parcels.summary(*parcels.apply_parcellation(v, f, _vertex_labels(spark, sf_dir), ignore=[3]))


def _spheres(spark, sf_dir):
    p = points(spark, sf_dir)
    values = table(spark, sf_dir, "embeddings").select(F.col("label").alias("shape_id"), F.col("vec_id").alias("vid"), F.get("embedding", F.lit(3)).cast("double").alias("value"))
    return values, p, p.where("shape_id = 0").drop("shape_id")


CARRIED = f"{PTS}, y AS (SELECT vec_id AS vid, embedding[4]::DOUBLE AS value FROM embeddings), t AS (SELECT vid, x, y, z FROM p WHERE shape_id = 0), n AS (SELECT p.shape_id, t.vid, y.value, sqrt(pow(t.x - p.x, 2) + pow(t.y - p.y, 2) + pow(t.z - p.z, 2)) AS d, row_number() OVER (PARTITION BY p.shape_id, t.vid ORDER BY pow(t.x - p.x, 2) + pow(t.y - p.y, 2) + pow(t.z - p.z, 2), p.vid) AS i FROM t, p JOIN y ON y.vid = p.vid)"


@query(f"{CARRIED} SELECT shape_id, vid, round(value, 6) + 0.0 AS value FROM n WHERE i = 1")
def resample_nearest(spark, sf_dir):
    return rounded(parcels.carried(*_spheres(spark, sf_dir)), "value")


@query(f"{CARRIED} SELECT shape_id, vid, round(sum(value / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)), 6) + 0.0 AS value FROM n WHERE i <= 3 GROUP BY ALL")
def resample_inverse(spark, sf_dir):
    return rounded(parcels.carried(*_spheres(spark, sf_dir), "inverse", 3), "value")


@query("WITH v AS (SELECT vec_id AS vid, round_even(embedding[1]::DOUBLE * 10, 0)::INT AS i, round_even(embedding[2]::DOUBLE * 10, 0)::INT AS j, round_even(embedding[3]::DOUBLE * 10, 0)::INT AS k FROM embeddings) SELECT vid, CASE WHEN abs(i) <= 1 AND abs(j) <= 1 AND abs(k) <= 1 THEN 9 * (i + 1) + 3 * (j + 1) + k + 1 ELSE 0 END AS value FROM v")
def volume_to_surface(spark, sf_dir):
    box = spark.range(27).select((F.floor(F.col("id") / 9) - 1).cast("int").alias("i"), (F.floor(F.col("id") / 3) % 3 - 1).cast("int").alias("j"), (F.col("id") % 3 - 1).cast("int").alias("k"), F.col("id").cast("int").alias("value"))
    return parcels.at_voxels(points(spark, sf_dir), box, [0.1, 0, 0, 0, 0, 0.1, 0, 0, 0, 0, 0.1, 0]).select("vid", "value")


@query("WITH p AS (SELECT l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS discount FROM lineitem) SELECT unnest(['discount', 'discount', 'price']) AS a, unnest(['price', 'quantity', 'quantity']) AS b, unnest([round(corr(discount, price), 6) + 0.0, round(corr(discount, quantity), 6) + 0.0, round(corr(price, quantity), 6) + 0.0]) AS r, count(*) AS n FROM p")
def descriptor_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount"))
    return rounded(compare.correlations(rows, ["quantity", "price", "discount"]), "r")


@query("WITH p AS (SELECT n_chars::DOUBLE AS a, length(text)::DOUBLE AS b FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM p) SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM r")
def descriptor_rank_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("a"), F.length("text").cast("double").alias("b"))
    return rounded(compare.correlations(rows, ["a", "b"], "spearman"), "r")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smooth FROM events")
def moving_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rounded(compare.moving_average(e, "value", "event_id", 5, "user_id").select("user_id", "event_id", "smooth"), "smooth")


@query("WITH z AS (SELECT p_brand AS brand, (p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w AS z FROM part WINDOW w AS (PARTITION BY p_brand)) SELECT brand, count(*) FILTER (z > 1.5) AS high, count(*) FILTER (z < -1.5) AS low, round(100.0 * count(*) FILTER (abs(z) > 1.5) / count(z), 6) + 0.0 AS share, round(max(z), 6) + 0.0 AS max_z, round(min(z), 6) + 0.0 AS min_z, round(avg(abs(z)), 6) + 0.0 AS mean_abs FROM z GROUP BY 1")
def extreme_count(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("x"))
    s = p.groupBy("brand").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    z = p.join(s, "brand").select("brand", ((F.col("x") - F.col("m")) / F.col("s")).alias("z"))
    return rounded(compare.extremes(z, "z", 1.5, "brand"), "share", "max_z", "min_z", "mean_abs")


@query(f"""{MESH}, lf AS (SELECT vec_id AS vid, list_transform(embedding::DOUBLE[], lambda x: ln(abs(x) + 1e-12)) AS f FROM embeddings),
 ed AS (SELECT u, e.v, list_distance(p.f, q.f) AS d FROM e JOIN lf p ON p.vid = u JOIN lf q ON q.vid = e.v JOIN v ON v.vid = u), s AS (SELECT shape_id, median(d) AS s FROM ed JOIN v ON vid = u WHERE d > 0 GROUP BY 1)
 SELECT u, ed.v, round(exp(-d * d / (2 * s * s)), 6) + 0.0 AS w FROM ed JOIN v ON vid = u JOIN s USING (shape_id)""")
def hks_affinity_graph(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    d = _rows(spark, sf_dir).select("vid", F.transform("f", F.abs).alias("f")).join(v.select("shape_id", "vid"), "vid")
    return rounded(compare.affinity_graph(d, geometry.edges(f)).select("u", "v", "w"), "w")


def _mean_rows(spark, sf_dir):
    return _means(spark, sf_dir).select(F.lit("m").alias("shape_id"), F.col("label").cast("long").alias("vid"), F.col("c").alias("f"))


for _metric, _sql in (("euclidean", "sqrt(sum(pow(a.c - b.c, 2)))"), ("manhattan", "sum(abs(a.c - b.c))"), ("cosine", "1 - sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)))")):
    QUERIES[f"descriptor_distance_{_metric}"] = lambda spark, sf_dir, m=_metric: rounded(compare.descriptor_distances(_mean_rows(spark, sf_dir), m, log=False).select("a", "b", "d"), "d")
    ORACLES[f"descriptor_distance_{_metric}"] = f"{MEAN}, u AS (SELECT label, k, c / sum(abs(c)) OVER (PARTITION BY label) AS c FROM c) SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round({_sql}, 6) + 0.0 AS d FROM u a JOIN u b ON a.k = b.k AND a.label < b.label GROUP BY ALL"


@query(f"{MEAN}, d AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.c - b.c, 2))) AS x, sum(abs(a.c - b.c)) AS y FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY ALL) SELECT a::BIGINT AS a, b::BIGINT AS b, round(0.7 * x / (SELECT median(x) FROM d) + 0.3 * y / (SELECT median(y) FROM d), 6) + 0.0 AS d FROM d")
def hybrid_distance(spark, sf_dir):
    m = _mean_rows(spark, sf_dir)
    out = compare.hybrid_distances(*(compare.descriptor_distances(m, metric, False, None) for metric in ("euclidean", "manhattan")))
    return rounded(out.select("a", "b", "d"), "d")


@query(f"{MEAN}, d AS (SELECT a.label AS a, b.label AS b, sum(pow(a.c - b.c, 2)) AS x, 4 * sum(pow(a.c - b.c, 2)) AS y FROM c a JOIN c b ON a.k = b.k AND a.label <= b.label GROUP BY ALL), s AS (SELECT pow(10, -1 + i / 2.0) AS s FROM range(0, 5) r(i)) SELECT a::BIGINT AS a, b::BIGINT AS b, round(avg((exp(-x / (2 * s * s)) + exp(-y / (2 * s * s))) / 2), 6) + 0.0 AS w FROM d, s GROUP BY ALL")
def fuse_multi_kernel(spark, sf_dir):
    m = _mean_rows(spark, sf_dir)
    return rounded(compare.multi_kernel(m, m.withColumn("f", F.transform("f", lambda x: 2 * x))).select("a", "b", "w"), "w")


@query()
def spectral_mds(spark, sf_dir):
    d = compare.descriptor_distances(_mean_rows(spark, sf_dir), "euclidean", False, None)
    return compare.classical_scaling(d, 3)


@query("SELECT l_linenumber AS vid, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) + 0.0 AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 6) + 0.0 AS p90 FROM lineitem GROUP BY 1")
def grouped_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("vid"), F.col("l_extendedprice").alias("x"))
    return rounded(order.quantiles(rows, "x", {"median": 0.5, "p90": 0.9}, "vid"), "median", "p90")


# ---- surfaces of clouds and volumes


@query()
def convex_hull(spark, sf_dir):
    return hulls.convex_hull(points(spark, sf_dir))


@query()
def marching_tetrahedra(spark, sf_dir):
    at = table(spark, sf_dir, "embeddings").select(F.col("label").alias("shape_id"), *((F.round(F.get("embedding", F.lit(n)).cast("double") * 10).cast("int")).alias(c) for n, c in enumerate("ijk"))).distinct()
    return hulls.isosurface(at.select("*", F.lit(1.0).alias("value"), *(F.col(c).cast("double").alias(x) for c, x in zip("ijk", "xyz", strict=True))))[0]


# ---- clusters


@query()
def cluster_hdbscan(spark, sf_dir):
    return density.hdbscan(_rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", "f"), 5, 3)


@query()
def cluster_communities(spark, sf_dir):
    edges, nodes = trade(spark, sf_dir)
    e = edges.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.sum("w").alias("w"))
    return density.communities(nodes.select(F.lit("t").alias("shape_id"), F.col("i").cast("long").alias("vid")), e.select(F.lit("t").alias("shape_id"), "u", "v", "w"))


@query()
def cluster_temporal_dtw(spark, sf_dir):
    return density.temporal_clusters(_rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", "f"), 3, landmarks=16)


@query()
def cluster_coclustering(spark, sf_dir):
    d = _rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", F.transform("f", F.abs).alias("f"))
    return density.coclusters(d, 4)[0]


# ---- cohorts


@query("SELECT toxic::VARCHAR AS level, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1")
def group_split(spark, sf_dir):
    people = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("subject"), F.col("toxic").cast("string").alias("value"))
    a, b = group.split(people)
    return a.agg(F.lit("0").alias("level"), F.count("*").alias("n")).unionByName(b.agg(F.lit("1").alias("level"), F.count("*").alias("n")))


GROUPS = """WITH e AS (SELECT user_id AS subject, day(ts) AS vid, sum(value) AS value FROM events GROUP BY ALL), s AS (SELECT DISTINCT subject FROM e), m AS (SELECT s.subject, d.vid::BIGINT AS vid, coalesce(e.value, 0) AS value, subject % 2 AS g FROM s CROSS JOIN (SELECT unnest(range(1, 32)) AS vid) d LEFT JOIN e USING (subject, vid)),
 a AS (SELECT vid, avg(value) FILTER (g = 0) AS ma, avg(value) FILTER (g = 1) AS mb, var_samp(value) FILTER (g = 0) / count(*) FILTER (g = 0) AS va, var_samp(value) FILTER (g = 1) / count(*) FILTER (g = 1) AS vb FROM m GROUP BY 1)"""


@query(f"{GROUPS} SELECT vid, round(CASE WHEN va + vb > 0 THEN (ma - mb) / sqrt(va + vb) ELSE 0 END, 6) + 0.0 AS t FROM a")
def group_comparison(spark, sf_dir):
    m = _users(spark, sf_dir)
    labels = m.select("subject", F.when(F.col("subject") % 2 == 0, "even").otherwise("odd").alias("value")).distinct()
    return rounded(group.comparison(m.drop("grp"), labels).select("vid", "t"), "t")


@query(f"{MAPS} SELECT vid, round((ma - mb) / sqrt(va / na + vb / nb), 6) + 0.0 AS t, round((ma - mb) / sqrt(pool), 6) + 0.0 AS cohens_d FROM d")
def vertexwise_effects(spark, sf_dir):
    return rounded(inference.vertexwise_ttest(maps(spark, sf_dir), "A", "R").select("vid", "t", "cohens_d"), "t", "cohens_d")


@query("WITH p AS (SELECT s_suppkey AS subject, 'sub-' || lpad(s_suppkey::VARCHAR, 4, '0') AS sub, CASE WHEN s_acctbal > 0 THEN 'control' ELSE 'patient' END AS value FROM supplier) SELECT subject, value FROM p")
def group_covariate(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("/data/sub-"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit("/anat/x_group-"), F.when(F.col("s_acctbal") > 0, "control").otherwise("patient"), F.lit("_thickness.shape.gii"))
    people = s.select(F.col("s_suppkey").alias("subject"), group.bids_entities(path).alias("entities"))
    return group.covariate(people, "group")


@query()
def normative_example(spark, sf_dir):
    return resample.normative_example(spark, 20, 10)


@query()
def connectome_example(spark, sf_dir):
    return resample.connectome_example(spark, 4, 10, 2)[0]


@query()
def laterality_example(spark, sf_dir):
    return resample.laterality_example(spark, 10, 9)


def _features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    return d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), "id").select("id", "label", F.array(F.col("n_chars").cast("double"), count("e"), count(" ")).alias("f"))


@query()
def classify(spark, sf_dir):
    return learn.classify(_features(spark, sf_dir), "logistic", 3)


@query()
def compare_methods(spark, sf_dir):
    f = _features(spark, sf_dir)
    return learn.compare_methods(f, f.withColumn("f", F.slice("f", 1, 1)), 3)


# ---- labels

_ASEG = ", ".join(f"({n}, '{name}', {i})" for i, (n, name) in enumerate(atlas.LABELS["aseg"].items()))


@query(f"SELECT s_suppkey, coalesce(name, 'Unknown-' || s_suppkey) AS name FROM supplier LEFT JOIN (VALUES {_ASEG}) a(id, name, i) ON id = s_suppkey")
def label_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", atlas.label_name(F.col("s_suppkey"), "aseg").alias("name"))


@query(f"SELECT n_name, (SELECT arg_min(id, i) FROM (VALUES {_ASEG}) a(id, name, i) WHERE contains(lower(name), lower(n_name[1:2])))::INT AS id FROM nation")
def label_id(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", atlas.label_id(F.substring("n_name", 1, 2), "aseg").alias("id"))


@query(f"SELECT id::INT AS id FROM (VALUES {_ASEG}) a(id, name, i) WHERE starts_with(name, 'Left')")
def structure_ids(spark, sf_dir):
    return atlas.structures(spark, "aseg", "left")


@query("SELECT s_suppkey, ['Visual', 'Somatomotor', 'DorsalAttention', 'VentralAttention', 'Limbic', 'Frontoparietal', 'Default'][least((s_suppkey % 50) // 7, 6) + 1] AS network FROM supplier")
def schaefer_to_yeo(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", atlas.yeo_network(F.col("s_suppkey") + 1, 100).alias("network"))


@query("SELECT unnest(['aal3', 'aparc', 'brainnetome', 'desikan', 'destrieux', 'dkt', 'glasser', 'harvard_oxford', 'hcp', 'julich', 'mmp', 'schaefer', 'schaefer_100', 'schaefer_1000', 'schaefer_200', 'schaefer_400', 'schaefer_600', 'schaefer_800']) AS name")
def list_atlases(spark, sf_dir):
    return atlas.atlases(spark).select("name")


# ---- figures


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("double").alias("x"))


@query("""WITH e AS (SELECT p_brand AS brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), b AS (SELECT p_brand AS brand, lo, (hi - lo) / 10 AS w, least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9)::INT AS bin FROM part JOIN e ON brand = p_brand WHERE hi > lo),
 c AS (SELECT brand, bin, lo, w, count(*) AS n FROM b GROUP BY ALL) SELECT brand, bin, round(lo + bin * w, 6) + 0.0 AS "left", n, round(n / sum(n) OVER (PARTITION BY brand) / w, 9) + 0.0 AS density FROM c""")
def figure_histogram(spark, sf_dir):
    wide = _prices(spark, sf_dir).join(_prices(spark, sf_dir).groupBy("brand").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b").select("brand"), "brand")
    return rounded(rounded(figures.histogram(wide, "x", 10, None, None, "brand"), "left"), "density", digits=9)


@query("""WITH s AS (SELECT o_orderpriority AS g, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders GROUP BY 1),
 x AS (SELECT g, i, lo - 3 * h + i * (hi - lo + 6 * h) / 19 AS x, n, h FROM s, range(0, 20) r(i))
 SELECT x.g, i::INT AS i, round(x, 4) + 0.0 AS x, round(sum(exp(-pow((x - o_totalprice) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 12) + 0.0 AS density FROM x JOIN orders ON o_orderpriority = x.g GROUP BY x.g, i, x""")
def figure_density(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"))
    return rounded(rounded(figures.density(rows, "v", 20, None, "g"), "x", digits=4), "density", digits=12)


@query("WITH s AS (SELECT s_suppkey AS id, abs(s_acctbal) / 20000 AS p, s_acctbal / 5000 AS d FROM supplier) SELECT id, round(-log10(greatest(p, 1e-300)), 6) + 0.0 AS height, p < 0.2 AND abs(d) > 0.3 AS marked FROM s")
def figure_volcano(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 20000).alias("p"), (F.col("s_acctbal") / 5000).alias("d"))
    return rounded(figures.volcano(s, "d", "p", 0.2, 0.3).select("id", "height", "marked"), "height")


SCORED = "WITH s AS (SELECT toxic AS y, n_chars::DOUBLE AS s FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND n_chars IS NOT NULL)"


def _scored(spark, sf_dir):
    return _scores(spark, sf_dir).select("y", F.col("s_a").alias("s"))


@query(f"{SCORED}, t AS (SELECT DISTINCT s FROM s) SELECT t.s AS threshold, round((count(*) FILTER (y = 0 AND s.s >= t.s)) / (count(*) FILTER (y = 0)), 9) + 0.0 AS fpr, round((count(*) FILTER (y = 1 AND s.s >= t.s)) / (count(*) FILTER (y = 1)), 9) + 0.0 AS tpr FROM s, t GROUP BY t.s")
def figure_roc(spark, sf_dir):
    return rounded(figures.roc_curve(_scored(spark, sf_dir)), "fpr", "tpr", digits=9)


@query(f"{SCORED} SELECT round(avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 9) + 0.0 AS auc FROM s a JOIN s b ON a.y = 1 AND b.y = 0")
def figure_auc(spark, sf_dir):
    return rounded(figures.area_under(_scored(spark, sf_dir)), "auc", digits=9)


@query(f"{MEAN} SELECT a.label::BIGINT AS i, b.label::BIGINT AS j, round(sqrt(sum(pow(a.c - b.c, 2))), 6) + 0.0 AS value FROM c a JOIN c b ON a.k = b.k GROUP BY ALL")
def figure_matrix(spark, sf_dir):
    return rounded(figures.full_matrix(compare.connectome(_parcels(spark, sf_dir), "euclidean")), "value")


@query("SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (abs(p_retailprice - 1200) > 200) AS beyond, round(avg((abs(p_retailprice - 1200) > 200)::INT), 6) + 0.0 AS share FROM part GROUP BY 1")
def figure_share_beyond(spark, sf_dir):
    return rounded(figures.share_beyond(_prices(spark, sf_dir).select("brand", (F.col("x") - 1200).alias("d")), "d", 200, "brand"), "share")


@query("SELECT l_orderkey, l_linenumber, 'left' AS side, l_discount::DOUBLE AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'right', l_tax::DOUBLE FROM lineitem")
def figure_sides(spark, sf_dir):
    return figures.sides(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("left"), F.col("l_tax").alias("right")))


@query("""WITH v AS (SELECT event_type AS t, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
 w AS (SELECT a.t, a.v AS lo, b.v AS hi FROM v a JOIN v b ON a.t = b.t AND b.i = a.i + greatest(ceil(a.n * 0.9)::INT - 1, 0)), m AS (SELECT t, avg(v) AS mean, count(*) AS n FROM v GROUP BY 1), b AS (SELECT t, min((hi - lo, lo, hi)) AS b FROM w GROUP BY 1)
 SELECT t, round(mean, 6) + 0.0 AS mean, b[2] AS low, b[3] AS high, n FROM m JOIN b USING (t)""")
def figure_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("t"), "value")
    return rounded(figures.intervals(e, "value", 0.9, "t"), "mean")


@query("SELECT event_type AS t, round(avg((value < 20)::INT), 6) + 0.0 AS below, round(avg((value BETWEEN 20 AND 60)::INT), 6) + 0.0 AS inside, round(avg((value > 60)::INT), 6) + 0.0 AS above FROM events WHERE value IS NOT NULL GROUP BY 1")
def figure_decision(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("t"), "value")
    return rounded(figures.decision(e, "value", 20.0, 60.0, "t"), "below", "inside", "above")


@query("SELECT s_suppkey AS vid, CASE WHEN abs(s_acctbal / 4000) > 1 THEN round(s_acctbal / 4000, 6) + 0.0 END AS shown FROM supplier")
def figure_masked(spark, sf_dir):
    z = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vid"), (F.col("s_acctbal") / 4000).alias("z"))
    return rounded(figures.masked(z, "z", 1.0).select("vid", "shown"), "shown")


@query(f"{PARCELS} SELECT u, e.v FROM e JOIN lb a ON a.vid = u JOIN lb b ON b.vid = e.v WHERE a.label <> b.label")
def figure_boundaries(spark, sf_dir):
    return figures.boundaries(_vertex_labels(spark, sf_dir), geometry.edges(terrain(spark, sf_dir)[1])).select("u", "v")


@query("WITH s AS (SELECT label AS shape_id, k - 1 AS component, sum(abs(embedding[k]::DOUBLE)) AS total FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL) SELECT shape_id, component::INT AS component, round(total, 6) + 0.0 AS total FROM s QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY total DESC, component) <= 4")
def figure_leading(spark, sf_dir):
    w = _rows(spark, sf_dir).select(F.col("label").alias("shape_id"), "vid", F.transform("f", F.abs).alias("weights"))
    return rounded(figures.leading(w), "total")


@query(f"{PARCELS}, c AS (SELECT *, avg(x) OVER s AS x0, avg(y) OVER s AS y0, avg(z) OVER s AS z0, avg(x) OVER l AS x1, avg(y) OVER l AS y1, avg(z) OVER l AS z1 FROM lb WINDOW s AS (PARTITION BY shape_id), l AS (PARTITION BY shape_id, label)) SELECT vid, label, round(x + (x1 - x0) / 2, 6) + 0.0 AS x, round(y + (y1 - y0) / 2, 6) + 0.0 AS y, round(z + (z1 - z0) / 2, 6) + 0.0 AS z FROM c")
def figure_exploded(spark, sf_dir):
    return rounded(figures.exploded(terrain(spark, sf_dir)[0], _vertex_labels(spark, sf_dir)).drop("shape_id"), "x", "y", "z")


@query(f"WITH {PAIRS} SELECT label, (k - 1)::INT AS t, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x) / sqrt(count(*)), 6) + 0.0 AS sem, count(*) AS n FROM x GROUP BY ALL")
def figure_profiles(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return rounded(figures.profiles(r.select("shape_id", "vid", "f"), r.select("shape_id", "vid", "label")), "mean", "sem")


@query("SELECT label - 1 AS label, count(*) AS n, label - 1 = -1 AS noise FROM embeddings GROUP BY 1")
def figure_sizes(spark, sf_dir):
    return figures.sizes(_rows(spark, sf_dir).select("vid", (F.col("label") - 1).alias("label")))


@query("""WITH l AS (SELECT 'm1' AS method, vec_id AS vid, label FROM embeddings UNION ALL SELECT 'm2', vec_id, (embedding[1] > 0)::INT FROM embeddings UNION ALL SELECT 'm3', vec_id, (label // 2)::INT FROM embeddings),
 c AS (SELECT x.method AS a, y.method AS b, x.label AS la, y.label AS lb, count(*)::DOUBLE AS n FROM l x JOIN l y ON x.vid = y.vid AND x.method < y.method GROUP BY ALL),
 p AS (SELECT a, b, sum(m * (m - 1) / 2) AS pa FROM (SELECT a, b, la, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL), q AS (SELECT a, b, sum(m * (m - 1) / 2) AS pb FROM (SELECT a, b, lb, sum(n) AS m FROM c GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT a, b, sum(n * (n - 1) / 2) AS ab, sum(n) AS n FROM c GROUP BY ALL)
 SELECT a, b, round((ab - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM t JOIN p USING (a, b) JOIN q USING (a, b)""")
def figure_agreement(spark, sf_dir):
    r = _rows(spark, sf_dir)
    one = lambda name, c: r.select(F.lit(name).alias("method"), "vid", c.cast("int").alias("label"))
    return rounded(figures.agreement(one("m1", F.col("label")).unionByName(one("m2", F.get("f", F.lit(0)) > 0)).unionByName(one("m3", F.floor(F.col("label") / 2)))), "ari")


@query(f"{MESH}, hv AS (SELECT v.shape_id, vid, least(floor((x - lo) / (hi - lo) * 5), 4)::INT AS bin FROM v JOIN (SELECT shape_id, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1) USING (shape_id)) SELECT shape_id, bin, (k - 1)::INT AS t, round(avg(embedding[k]::DOUBLE), 6) + 0.0 AS mean, count(*) AS n FROM hv JOIN embeddings ON vec_id = vid, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL")
def figure_hovmoller(spark, sf_dir):
    v, _ = terrain(spark, sf_dir)
    fields = _rows(spark, sf_dir).select(F.floor(F.col("vid") / 512).alias("shape_id"), "vid", F.posexplode("f").alias("t", "value"))
    return rounded(figures.hovmoller(v, fields, "x", 5), "mean")


@query("SELECT vec_id AS vid, round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def figure_difference(spark, sf_dir):
    at = lambda n: _rows(spark, sf_dir).select("shape_id", "vid", F.get("f", F.lit(n)).alias("value"))
    return rounded(figures.difference(at(0), at(1)).select("vid", "value"), "value")


@query()
def figure_kymograph(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    return figures.along_line(v.select("shape_id", "vid", "x", "y", F.col("z").alias("value")), f, (0.0, 0.0), (15.0, 15.0), 20)


@query("WITH l AS (SELECT user_id AS obs, event_id AS draw, -abs(value) / 100 AS ll FROM events), t AS (SELECT obs, max(ll) AS top, var_samp(ll) AS v FROM l GROUP BY 1 HAVING count(*) > 1), m AS (SELECT obs, top + ln(avg(exp(ll - top))) AS e, any_value(v) AS v FROM l JOIN t USING (obs) GROUP BY obs, top) SELECT round(sum(e) - sum(v), 6) + 0.0 AS elpd, round(sum(v), 6) + 0.0 AS p_waic, round(-2 * (sum(e) - sum(v)), 6) + 0.0 AS waic, count(*) AS n FROM m")
def bayes_waic(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("obs"), F.col("event_id").alias("draw"), (-F.abs("value") / 100).alias("ll"))
    more = e.groupBy("obs").agg(F.count("*").alias("n")).where("n > 1").select("obs")
    return rounded(bayes.waic(e.join(more, "obs")), "elpd", "p_waic", "waic")


@query()
def bayes_connectome(spark, sf_dir):
    edges, _ = resample.connectome_example(spark, 12, 8, 2)
    return bayes.effects(bayes.edge_differences(edges.withColumn("grp", F.col("grp").cast("string")), "0", "1", 200, 100, 2), "diff_")


@query()
def bayes_spatial(spark, sf_dir):
    e = spark.range(1, 31).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    return bayes.effects(bayes.spatial_effect(_users(spark, sf_dir), e, "a", "b", draws=100, tune=50, chains=2))


# ---- signals on graphs


def _on_mesh(spark, sf_dir):
    v, f = terrain(spark, sf_dir)
    d = _rows(spark, sf_dir).select("vid", F.transform("f", F.abs).alias("f")).join(v.select("shape_id", "vid"), "vid")
    return d.select("shape_id", "vid", "f"), geometry.edges(f)


@query()
def denoise_joint(spark, sf_dir):
    return signals.denoise_joint(*_on_mesh(spark, sf_dir))


@query()
def cluster_joint_spectral(spark, sf_dir):
    return signals.cluster_bands(*_on_mesh(spark, sf_dir))


@query()
def cluster_wavelet_coefficients(spark, sf_dir):
    return signals.cluster_wavelets(*_on_mesh(spark, sf_dir))


@query()
def cluster_multiview(spark, sf_dir):
    return signals.cluster_views(*_on_mesh(spark, sf_dir))


@query()
def auto_cluster(spark, sf_dir):
    return signals.auto_cluster(*_on_mesh(spark, sf_dir), {"bands": "bands", "wavelets": "wavelets", "gnmf": lambda d, e: cluster.gnmf(d, e, 3)})


@query()
def fuse_joint_nmf(spark, sf_dir):
    d, _ = _on_mesh(spark, sf_dir)
    return signals.joint_factors(d, d.withColumn("f", F.transform("f", lambda x: x * x)), 4, 50)


@query()
def tensor_decomposition(spark, sf_dir):
    m = _users(spark, sf_dir).select(F.lit("t").alias("shape_id"), "subject", F.floor((F.col("vid") - 1) / 8).cast("long").alias("vid"), (F.col("vid") - 1).alias("day"), "value")
    rows = m.groupBy("shape_id", "subject", "vid").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "value"))), lambda s: s["value"]).alias("f")).where("size(f) = 8")
    return signals.tensor_factors(rows, 3, 50)


@query()
def cluster_vineyards(spark, sf_dir):
    d, e = _on_mesh(spark, sf_dir)
    return signals.vines(d.select("shape_id", "vid", F.posexplode("f").alias("t", "value")), e)
