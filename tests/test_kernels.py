"""Kernels on whole shapes against analytic values and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.operators import cloud, eigen, geometry, spectral


def sphere(n=12, m=24):
    """Closed sphere of radius 1: vertices with merged poles, and faces."""
    theta = np.pi * np.arange(1, n) / n
    v = [(0.0, 0.0, 1.0)] + [(np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)) for t in theta for p in 2 * np.pi * np.arange(m) / m] + [(0.0, 0.0, -1.0)]
    at, last, f = lambda i, j: 1 + i * m + j % m, len(v) - 1, []
    for j in range(m):
        f += [(0, at(0, j), at(0, j + 1)), (last, at(n - 2, j + 1), at(n - 2, j))]
        for i in range(n - 2):
            f += [(at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    return v, f


@pytest.fixture(scope="module")
def ball(spark):
    v, f = sphere(24, 40)
    return (
        spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(v)], "shape_id string, vid long, x double, y double, z double").cache(),
        spark.createDataFrame([("s", i, *p) for i, p in enumerate(f)], "shape_id string, fid long, i0 long, i1 long, i2 long").cache(),
    )


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    return spark.createDataFrame([(i % 2, i, *map(float, draw.normal(size=3))) for i in range(120)], "shape_id int, vid long, x double, y double, z double").cache()


def arrays(points, shape):
    rows = points.where(F.col("shape_id") == shape).orderBy("vid").collect()
    return np.array([r.vid for r in rows]), np.array([(r.x, r.y, r.z) for r in rows])


def test_sphere_spectrum_and_quality(ball):
    v, f = ball
    mass = geometry.vertex_areas(v, f)
    eig = eigen.decompose(geometry.cotangent_laplacian(v, f), mass, 10).cache()
    lam = np.array(eig.first().lam)
    assert abs(lam[0]) < 1e-8
    assert np.allclose(lam[1:4], 2, rtol=0.05) and np.allclose(lam[4:9], 6, rtol=0.05)
    qc = eigen.spectral_qc(eig, mass).first()
    assert qc.passed and qc.orthonormality < 1e-8
    assert spectral.hks(eig, n_times=3).count() == 3 * v.count()


def test_filtered_iteration_equals_dense(monkeypatch):
    draw = np.random.default_rng(5)
    p = draw.normal(size=(400, 3))
    w = np.exp(-((p[:, None] - p[None]) ** 2).sum(-1))
    lap = np.diag(w.sum(1)) - w
    i, j = np.nonzero(np.ones_like(lap))
    a, mass = eigen.Sparse(i, j, lap[i, j], 400), 0.5 + draw.random(400)
    want, _ = eigen.smallest_pairs(a, mass, 8)
    monkeypatch.setattr(eigen, "DENSE", 10)
    have, phi = eigen.smallest_pairs(a, mass, 8)
    assert np.allclose(have, want, atol=1e-5)
    assert np.allclose(phi.T @ (phi * mass[:, None]), np.eye(8), atol=1e-6)


def test_geodesics_reach_the_other_pole(ball):
    v, f = ball
    last = v.count() - 1
    walk = {r.vid: r.distance for r in eigen.geodesic_dijkstra(geometry.edge_lengths(v, f), [0]).collect()}
    heat = {r.vid: r.distance for r in eigen.geodesic_heat(v, f, [0]).collect()}
    assert walk[0] == 0 and abs(walk[last] - np.pi) < 0.05
    assert abs(heat[0]) < 1e-9 and abs(heat[last] - np.pi) < 0.25
    assert np.corrcoef([walk[i] for i in range(last + 1)], [heat[i] for i in range(last + 1)])[0, 1] > 0.99


def test_anisotropy_of_zero_changes_nothing(ball):
    v, f = ball
    plain = {(r.i, r.j): r.w for r in geometry.cotangent_laplacian(v, f).collect()}
    same = {(r.i, r.j): r.w for r in eigen.anisotropic_laplacian(v, f, 0.0).collect()}
    assert plain.keys() == same.keys() and all(abs(plain[k] - same[k]) < 1e-9 for k in plain)


def test_wavelets_by_polynomials_equal_those_by_eigenpairs(ball):
    v, f = ball
    lap = geometry.cotangent_laplacian(v, f)
    ones = geometry.vertex_areas(v, f).withColumn("area", F.lit(1.0))
    n = v.count()
    eig = eigen.decompose(lap, ones, n)
    rows = {r.vid: r for r in eig.collect()}
    phi, lam = np.array([rows[i].phi for i in range(n)]), np.array(rows[0].lam)
    signal = v.select("shape_id", "vid", F.col("z").alias("value"))
    z = np.array([r.z for r in v.orderBy("vid").collect()])
    have = {(r.vid): r.value for r in eigen.sgw_transform(lap, signal, [0.5], order=40).collect()}
    want = phi @ ((0.5 * lam * np.exp(-0.5 * lam)) * (phi.T @ z))
    assert np.allclose([have[i] for i in range(n)], want, atol=1e-4)


def test_functional_map_of_a_shape_to_itself(ball):
    v, f = ball
    eig = eigen.decompose(geometry.cotangent_laplacian(v, f), geometry.vertex_areas(v, f), 6)
    base = v.select("vid", F.array("x", "y", "z", F.col("x") * F.col("y"), F.lit(1.0), F.col("z") * F.col("z"), F.exp("x"), F.exp("y")).alias("q")).select("vid", F.posexplode("q").alias("d", "value"))
    fields = base.withColumn("side", F.lit("a")).unionByName(base.withColumn("side", F.lit("b")))
    c = eigen.functional_map(eig, eig, fields, 4, 1e-9)
    assert np.allclose(c, np.eye(4), atol=1e-4)
    assert np.allclose(eigen.shape_difference(c, "conformal"), 0, atol=1e-4)
    assert eigen.dwks(eig, eigen.shape_difference(c), 5).count() == 5 * v.count()


def test_neighbours_equal_brute_force(points):
    have = {}
    for r in cloud.knn_search(points, 4).collect():
        have.setdefault((r.shape_id, r.vid), []).append((r.rank, r.to))
    near = {(r.vid, r.to) for r in cloud.radius_search(points, 0.7).collect()}
    want_near = set()
    for shape in (0, 1):
        ids, p = arrays(points, shape)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        for i, row in enumerate(d):
            assert [t for _, t in sorted(have[shape, ids[i]])] == ids[np.argsort(row, kind="stable")[:4]].tolist()
            want_near |= {(ids[i], ids[j]) for j in np.flatnonzero(row <= 0.7)}
    assert near == want_near


def test_density_frames_and_samples(points):
    assert cloud.density(points).where("density > 0").count() == points.count()
    kept, out = cloud.denoise(points, 6, 1.5).count(), cloud.density_outliers(points, 6, 1.5).where("outlier").count()
    assert out > 0 and kept + out == points.count()
    n = cloud.normals(points).select((F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2).alias("l"))
    assert all(abs(r.l - 1) < 1e-9 for r in n.collect())
    assert cloud.local_curvature(points).where("variation between 0 and 0.34").count() == points.count()
    got = cloud.farthest_points(points, 10).groupBy("shape_id").agg(F.countDistinct("vid").alias("n")).collect()
    assert [r.n for r in got] == [10, 10]


def test_axes_and_alignment(points):
    for r in cloud.covariance(cloud.align_to_pca(points)).collect():
        assert abs(r.xy) < 1e-9 and abs(r.xz) < 1e-9 and r.xx >= r.yy >= r.zz
    turned = points.select("shape_id", "vid", (-2 * F.col("y") + 1).alias("x"), (2 * F.col("x") - 3).alias("y"), (2 * F.col("z")).alias("z"))
    back = cloud.procrustes(points, turned).alias("a").join(turned.alias("b"), ["shape_id", "vid"])
    assert back.count() == points.count()
    assert back.where("abs(a.x-b.x) + abs(a.y-b.y) + abs(a.z-b.z) > 1e-8").count() == 0


def test_cloud_distances(points):
    moved = points.withColumn("x", F.col("x") + 0.01)
    r = cloud.cloud_distances(points, moved).collect()
    assert len(r) == 2 and all(abs(x.hausdorff - 0.01) < 1e-9 and abs(x.chamfer - 2e-4) < 1e-9 for x in r)


@pytest.mark.parametrize("kind", ["gaussian", "belkin_niyogi"])
def test_rows_of_cloud_laplacians_sum_to_zero(points, kind):
    lap = cloud.knn_laplacian(points, 8, kind).cache()
    assert lap.groupBy("shape_id", "i").agg(F.sum("w").alias("s")).where("abs(s) > 1e-9").count() == 0
    assert lap.alias("a").join(lap.alias("b"), [F.col("a.i") == F.col("b.j"), F.col("a.j") == F.col("b.i")]).where("abs(a.w - b.w) > 1e-12").count() == 0
    lam = eigen.decompose_cloud(lap, 5).first().lam
    assert abs(lam[0]) < 1e-8 and lam[1] > 0


def test_eigenpairs_out_of_tolerance_raise():
    import numpy as np
    import pytest

    from eigenlake.operators import eigen

    n = eigen.DENSE + 1
    i = np.arange(n)
    a = eigen.Sparse(np.concatenate([i, i, i]), np.concatenate([i, (i + 1) % n, (i - 1) % n]), np.concatenate([np.full(n, 2.0), np.full(2 * n, -1.0)]), n)
    with pytest.raises(ArithmeticError):
        eigen.smallest_pairs(a, np.ones(n), 2, tol=0.0)


def _cloud_laplacian(spark, p, k=10):
    rows = spark.createDataFrame([("c", i, *map(float, x)) for i, x in enumerate(p)], "shape_id string, vid long, x double, y double, z double")
    return cloud.knn_laplacian(rows, k)


@pytest.mark.parametrize("kind", ["copies", "dense group"])
def test_eigenpairs_of_clouds_whose_values_crowd_near_zero(spark, monkeypatch, kind):
    draw = np.random.default_rng(5)
    p = np.repeat(draw.normal(size=(900, 3)), 2, axis=0) if kind == "copies" else np.concatenate([draw.normal(size=(900, 3)), draw.normal(0, 0.05, (950, 3))])
    e = _cloud_laplacian(spark, p).toPandas()
    a = eigen.Sparse(e["i"].to_numpy(), e["j"].to_numpy(), e["w"].to_numpy(), len(p))
    mass = e[e["i"] == e["j"]].sort_values("i")["mass"].to_numpy()
    have, phi = eigen.smallest_pairs(a, mass, 10)
    assert np.allclose(phi.T @ (phi * mass[:, None]), np.eye(10), atol=1e-8)
    assert np.abs((a @ phi - mass[:, None] * phi * have) / np.sqrt(mass)[:, None]).max() < 1e-8
    monkeypatch.setattr(eigen, "DENSE", len(p))
    assert np.allclose(have, eigen.smallest_pairs(a, mass, 10)[0], rtol=1e-3, atol=1e-12)


def test_points_with_more_copies_than_neighbours_keep_their_degree(spark):
    p = np.repeat(np.random.default_rng(6).normal(size=(20, 3)), 15, axis=0)
    lap = _cloud_laplacian(spark, p).cache()
    assert lap.where("i = j and mass > 0").count() == len(p)
    assert lap.groupBy("i").agg(F.sum("w").alias("s")).where("abs(s) > 1e-9").count() == 0
    rows = eigen.decompose_cloud(lap, 5).collect()
    assert sorted(r.vid for r in rows) == list(range(len(p)))
    assert all(abs(x) < 1e-9 for x in rows[0].lam)
