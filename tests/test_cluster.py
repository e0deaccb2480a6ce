"""Clusters and resampling by their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.operators import cluster, geometry, resample


@pytest.fixture(scope="module")
def blobs(spark):
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(c, 0.2, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    rows = [("s", i, [float(v) for v in p], i // 30) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "shape_id string, vid long, f array<double>, label int").cache()


@pytest.mark.parametrize("method", ["kmeans", "spectral", "dbscan", "mixture", "fpca"])
def test_methods_find_the_groups(blobs, method):
    d = blobs.drop("label")
    if method == "fpca":  # rows of equal shape differ in profile only
        assert cluster.temporal_fpca(d, 1, 2).count() == 90
        return
    out = {"kmeans": lambda: cluster.kmeans(d, 3), "spectral": lambda: cluster.spectral_clusters(d, 3, 8), "dbscan": lambda: cluster.dbscan(d, 1.0, 4), "mixture": lambda: cluster.mixture(d, 3)}[method]()
    r = cluster.comparison(blobs, out).first()
    assert abs(r.ari - 1) < 1e-9 and abs(r.nmi - 1) < 1e-9


def test_quality_by_brute_force(blobs):
    rows = blobs.orderBy("vid").collect()
    x, l = np.array([r.f for r in rows]), np.array([r.label for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(90):
        a = d[i, l == l[i]].sum() / 29
        b = min(d[i, l == k].mean() for k in range(3) if k != l[i])
        s.append((b - a) / max(a, b))
    assert abs(cluster.silhouette(blobs).first().silhouette - np.mean(s)) < 1e-9
    q = cluster.quality(blobs).first()
    c = np.array([x[l == k].mean(0) for k in range(3)])
    w, b = ((x - c[l]) ** 2).sum(), 30 * ((c - x.mean(0)) ** 2).sum()
    assert q.clusters == 3 and abs(q.calinski_harabasz - (b / 2) / (w / 87)) < 1e-6 * q.calinski_harabasz
    assert 0 < q.davies_bouldin < 0.5


def test_graph_methods(spark, blobs):
    v, f = resample.uv_sphere(spark, 8, 12)
    e = geometry.edges(f).select("shape_id", "u", "v").cache()
    field = v.select("shape_id", "vid", F.abs("z").alias("value"))
    out = cluster.persistence(field, e).cache()
    assert out.select("label").distinct().count() == 2 and out.where("peak in (0, 85)").count() == v.count()
    assert cluster.persistence(field, e, k=1).select("label").distinct().count() == 1
    d = v.select("shape_id", "vid", F.array(F.greatest("z", F.lit(0.0)), F.greatest(-F.col("z"), F.lit(0.0))).alias("f"))
    g = cluster.gnmf(d, e, 2, 0.1, 0.1).cache()
    assert g.count() == v.count() and cluster.coherence(g, e).first().coherence > 0.7
    assert cluster.st_dbscan(d, e, 30.0, 1, 3).where("label >= 0").count() > v.count() / 2
    peaks = cluster.scalespace_blobs(field.withColumn("t", F.lit(0)).withColumn("time", F.lit(1.0)), e).collect()
    assert {r.vid for r in peaks} == {0, v.count() - 1}
    nodes, links = cluster.mapper(blobs.drop("label"), 5, 0.3, 1.0, 3)
    assert nodes.select("vid").distinct().count() > 60 and links.where("shared < 1").count() == 0
    assert cluster.fuse(d, d).where("size(f) = 4").count() == v.count()
    assert len(cluster.gmm_codebook(blobs, 2)[0]) == 2


def test_closed_ellipsoid(spark):
    v, f = resample.uv_sphere(spark, 10, 16, (3.0, 2.0, 1.0))
    t = geometry.topology(v, f).first()
    assert t.euler == 2 and t.closed


def test_bootstrap_brackets_the_mean_and_ignores_partitions(spark):
    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(draw.normal(1, 1, 80))], "id long, value double")
    for method in ("percentile", "bca"):
        a, b = resample.bootstrap_mean(df, 500, seed=3, method=method).first(), resample.bootstrap_mean(df.repartition(5), 500, seed=3, method=method).first()
        assert a.low < a.mean < a.high and abs(a.low - b.low) < 1e-9
    pairs = df.select("id", F.col("value").alias("a"), (F.col("value") - 1).alias("b"))
    r = resample.bootstrap_paired_difference(pairs, 100).first()
    assert abs(r.low - 1) < 1e-9 and abs(r.high - 1) < 1e-9


def test_nulls_keep_what_they_must(spark):
    labels = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(10)], "subject long, label string")
    out = resample.null_labels(labels, 5)
    assert out.groupBy("surrogate").agg(F.count_if(F.col("label") == "a").alias("n")).where("n = 4").count() == 5
    lam = spark.createDataFrame([("s", k, float(k * k)) for k in range(6)], "shape_id string, k int, lambda double")
    got = resample.null_eigenvalues(lam, 3).groupBy("surrogate").agg(F.sort_array(F.collect_list("lambda")).alias("l")).collect()
    assert [r.l for r in got] == [[float(k * k) for k in range(6)]] * 3
    edges = spark.createDataFrame([(i, (i + d) % 12, 1.0) for i in range(12) for d in (1, 3)], "i long, j long, w double")
    r = resample.null_rewired(edges, 4).cache()
    assert r.count() == 96 and r.select("surrogate", "i", "j").distinct().count() == 96
    degree = r.select("surrogate", F.explode(F.array("i", "j")).alias("n")).groupBy("surrogate", "n").count()
    assert degree.where("count <> 4").count() == 0
    v, _ = resample.uv_sphere(spark, 6, 8)
    spun = resample.null_spin(v.withColumn("value", F.col("z")), 3, 1).cache()
    assert spun.count() == 3 * v.count()
    assert spun.join(v, ["shape_id", "vid"]).where("abs(value - z) > 1").count() > 0
    eig = spark.createDataFrame([("s", 0, [1.0, 2.0]), ("s", 1, [0.0, 1.0])], "shape_id string, vid long, phi array<double>")
    c = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0)], "shape_id string, k int, c double")
    assert resample.null_phase(c, eig, 2).where("abs(value) <= 7").count() == 4
    m = spark.createDataFrame([(0, 5.0, 0.0), (1, 0.0, 1.0)], "vid long, mean double, std double")
    assert resample.null_parametric(m, 200).where("vid = 0 and value = 5").count() == 200


def test_synthetic_data(spark):
    p = resample.random_cloud(spark, 2000, "blob", (1.0, 2.0, 3.0)).agg(*(F.stddev("xyz"[i]) for i in range(3))).first()
    assert np.allclose(p, (1, 2, 3), rtol=0.1)
    assert resample.random_cloud(spark, 50, "sphere", noise=0.0).where("abs(x*x+y*y+z*z-2500) > 1e-6").count() == 0
    assert resample.random_cloud(spark, 50, "multi_cluster").select("cluster").distinct().count() == 5
    maps = resample.random_maps(spark, 20, 50, 4, 2.0).where("vid < 10").groupBy("grp").agg(F.avg("value").alias("m")).orderBy("grp").collect()
    assert maps[1].m - maps[0].m > 1.7


def test_mixtures_read_whole_vectors(spark, tmp_path):
    from eigenlake.plans.shape_queries import QUERIES

    draw = np.random.default_rng(9)
    rows = [(i, [*draw.normal(0, 0.1, 8).tolist(), *draw.normal(3.0 * (i % 2), 0.1, 56).tolist()], i % 2) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    groups = [set(), set()]
    for r in QUERIES["cluster_mixture"](spark, str(tmp_path)).collect():
        groups[r.vid % 2].add(r.label)
    assert not groups[0] & groups[1]
    fv = [np.array(r.fv) for r in QUERIES["fisher_vector"](spark, str(tmp_path)).orderBy("shape_id").collect()]
    assert all(len(x) == 2 * 4 * 64 for x in fv) and fv[0] @ fv[1] < 0.9


def test_codebook_of_known_groups(blobs):
    w, m, v = cluster.gmm_codebook(blobs, 3)
    x, l = np.array([r.f for r in blobs.orderBy("vid").collect()]), np.arange(90) // 30
    order = np.argsort([a - b for a, b in m])
    for i, k in zip(order, (2, 0, 1), strict=True):
        assert abs(w[i] - 1 / 3) < 1e-9 and np.allclose(m[i], x[l == k].mean(0)) and np.allclose(v[i], x[l == k].var(0) + 1e-6)
