"""Operators whose queries have no SQL, against closed forms, brute force and planted structure."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.functions import atlas
from eigenlake.operators import compare, density, eigen, geometry, hulls, learn, order, parcels, resample, spectral
from eigenlake.sources import formats, group


@pytest.fixture(scope="module")
def sphere(spark):
    v, f = resample.uv_sphere(spark, 24, 36, (2.0, 2.0, 2.0))
    return v.cache(), f.cache()


def test_sphere_curvatures(sphere):
    c = geometry.curvatures(*sphere, signed=True).join(sphere[0], ["shape_id", "vid"]).where("abs(z) < 1.5")
    r = c.agg(F.avg("h").alias("h"), F.avg("k").alias("k"), F.min("shape_index").alias("s"), F.avg("curvedness").alias("c")).first()
    assert abs(r.h - 0.5) < 0.02 and abs(r.k - 0.25) < 0.02 and r.s > 0.7 and abs(r.c - 0.5) < 0.03
    assert abs(geometry.willmore_energy(*sphere).first().energy - 4 * np.pi) < 1.0
    areas = geometry.voronoi_areas(*sphere)
    assert abs(areas.agg(F.sum("area")).first()[0] - geometry.surface_area(*sphere).first().area) < 1e-9 and areas.where("area <= 0").count() == 0
    report = geometry.quality_report(*sphere).first()
    assert report.euler == 2 and report.closed and report.boundary_vertices == 0
    assert geometry.boundary_vertices(sphere[1].where("fid <> 10")).count() == 3


def test_hulls(spark):
    rng = np.random.default_rng(0)
    cube = [(x, y, z) for x in (0, 1) for y in (0, 2) for z in (0, 3)] + rng.uniform([0, 0, 0], [1, 2, 3], (200, 3)).tolist()
    ball = rng.standard_normal((800, 3))
    ball = (ball / np.linalg.norm(ball, axis=1, keepdims=True)).tolist()
    flat = [(x, y, 0.0) for x in range(4) for y in range(4)]
    rows = [(s, i, *map(float, p)) for s, cloud in (("cube", cube), ("ball", ball), ("flat", flat), ("few", cube[:3])) for i, p in enumerate(cloud)]
    got = {r.shape_id: r for r in hulls.convex_hull(spark.createDataFrame(rows, "shape_id string, vid long, x double, y double, z double")).collect()}
    assert abs(got["cube"].volume - 6) < 1e-9 and abs(got["cube"].area - 22) < 1e-9
    assert 4.0 < got["ball"].volume < 4 * np.pi / 3 and got["ball"].faces == 2 * 800 - 4  # all points are corners
    assert got["flat"].volume == 0 and got["few"].faces == 0


def test_isosurface_of_a_ball(spark):
    at = [(i, j, k) for i in range(-8, 9) for j in range(-8, 9) for k in range(-8, 9) if i * i + j * j + k * k <= 49]
    rows = [("b", *p, 1.0, *(2.0 * x + 1 for x in p)) for p in at]
    v, f = hulls.isosurface(spark.createDataFrame(rows, "shape_id string, i int, j int, k int, value double, x double, y double, z double"))
    v, f = v.cache(), f.cache()
    t = geometry.topology(v, f).first()
    assert t.closed and t.euler == 2
    volume = geometry.corners(v, f).agg(F.sum((F.col("x0") * (F.col("y1") * F.col("z2") - F.col("z1") * F.col("y2")) - F.col("y0") * (F.col("x1") * F.col("z2") - F.col("z1") * F.col("x2")) + F.col("z0") * (F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2"))) / 6)).first()[0]
    assert 0.85 < volume / (8 * len(at)) < 1.1  # outwards, so positive
    r = v.agg(F.avg("x"), F.max("x")).first()
    assert abs(r[0] - 1) < 0.2 and 14 < r[1] < 17


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((60, 2)) * 0.2, rng.standard_normal((60, 2)) * 0.5 + 6, rng.uniform(-4, 10, (12, 2))])
    label = density.hdbscan_labels(x, 10, 5)
    first, second = np.bincount(label[:60] + 1).argmax() - 1, np.bincount(label[60:120] + 1).argmax() - 1
    assert first >= 0 and second >= 0 and first != second and (label[:60] == first).mean() > 0.9 and (label[60:120] == second).mean() > 0.8
    assert (label[120:] == -1).mean() > 0.2 and set(label.tolist()) == {-1, 0, 1}  # what falls out of a taken cluster is its own
    assert density.hdbscan_labels(x[:1], 10, 5).tolist() == [-1]


def test_communities(spark):
    pairs = [(a, b, 1.0) for block in (range(6), range(6, 12), range(12, 18)) for a in block for b in block if a < b] + [(5, 6, 1.0), (11, 12, 1.0)]
    nodes = spark.range(19).select(F.lit("g").alias("shape_id"), F.col("id").alias("vid"))
    edges = spark.createDataFrame([("g", *p) for p in pairs], "shape_id string, u long, v long, w double")
    got = [r.label for r in density.communities(nodes, edges).orderBy("vid").collect()]
    assert got == [0] * 6 + [1] * 6 + [2] * 6 + [3]


def test_series_clusters(spark):
    t = np.linspace(0, 2 * np.pi, 24)
    rng = np.random.default_rng(2)
    rows = [("s", i, (np.sin(t + 0.2 * rng.random()) if i % 2 else np.linspace(-1, 1, 24)).tolist()) for i in range(30)]
    got = {r.vid: r.label for r in density.temporal_clusters(spark.createDataFrame(rows, "shape_id string, vid long, f array<double>"), 2).collect()}
    assert len({got[i] for i in range(0, 30, 2)}) == 1 and len({got[i] for i in range(1, 30, 2)}) == 1 and got[0] != got[1]
    x, y = rng.random((3, 5)), rng.random(4)
    hard = np.full((6, 5), np.inf)
    hard[0, 0] = 0
    for i in range(1, 6):
        for j in range(1, 5):
            hard[i, j] = (x[0, i - 1] - y[j - 1]) ** 2 + min(hard[i - 1, j], hard[i, j - 1], hard[i - 1, j - 1])
    assert abs(density._soft_dtw(x, y, 1e-6)[0] - hard[5, 4]) < 1e-4


def test_coclusters(spark):
    rng = np.random.default_rng(3)
    m = np.kron(np.eye(3), np.ones((10, 6))) + 0.05 * rng.random((30, 18))
    df = spark.createDataFrame([("m", i, r.tolist()) for i, r in enumerate(m)], "shape_id string, vid long, f array<double>")
    rows, entries = density.coclusters(df, 3)
    a, b = ([r.label for r in d.orderBy(o).collect()] for d, o in ((rows, "vid"), (entries, "entry")))
    assert len(set(a)) == 3 and all(len(set(a[i : i + 10])) == 1 for i in (0, 10, 20)) and [b[0], b[6], b[12]] == [a[0], a[10], a[20]]


def test_scaling_and_mmd(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 3))
    rows = [("m", i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(12) for j in range(i + 1, 12)]
    got = np.array([r.x for r in compare.classical_scaling(spark.createDataFrame(rows, "shape_id string, a long, b long, d double"), 3).orderBy("vid").collect()])
    assert all(abs(np.linalg.norm(got[i] - got[j]) - d) < 1e-6 for _, i, j, d in rows)
    assert compare.mmd(x, x) == 0 and compare.mmd(x, x + 5) > 0.5


def test_ranks_and_quantiles_by_key(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 3000), np.where(rng.random(3000) < 0.4, 7.0, rng.standard_normal(3000).round(2)), strict=True)] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = order.midranks(df, "v", "r", "k").collect()
    assert len(got) == len(rows) and all(r.r is None for r in got if r.v is None)
    for k in range(3):
        own = sorted(v for a, v in rows if a == k and v is not None)
        want = {v: own.index(v) + (own.count(v) + 1) / 2 for v in set(own)}
        assert all(r.r == want[r.v] for r in got if r.k == k and r.v is not None)
    for r in order.quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}, "k").collect():
        own = [v for k, v in rows if k == r.k and v is not None]
        assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(own, [0, 0.25, 0.5, 1]))


def test_descriptor_edges(spark):
    rows = [("a", 0, [0.0, 1.0], [0.5, 0.5]), ("a", 1, None, [1.0]), ("a", 2, [0.0, 1.0], [1.0]), ("b", 0, [0.0, 2.0], [0.5, 0.1]), ("c", 0, [], [])]
    eig = spark.createDataFrame(rows, "shape_id string, vid long, lam array<double>, phi array<double>")
    got = {(r.shape_id, r.vid): r.hks for r in spectral.hks(eig, times=[0.0]).collect()}
    assert got == {("a", 0): 0.5, ("a", 1): None, ("a", 2): None, ("b", 0): 0.26, ("c", 0): None}
    values = spark.createDataFrame([("a", k, float(k)) for k in range(3)], "shape_id string, k int, lambda double")
    assert spectral.truncated(values, 2).count() == 2
    with pytest.raises(Exception, match="fewer eigenpairs"):
        spectral.truncated(values, 4).collect()
    assert spectral.gaps(values).first()[1:] == (1.0, 1.0)
    c = eigen.chebyshev_series(lambda y: y**3 - y, 5, 2.0)
    y = np.linspace(0, 2, 9)
    assert np.allclose(np.polynomial.chebyshev.chebval(y - 1, c), y**3 - y)


def test_parcels(spark, sphere):
    v, f = sphere
    labels = v.select("shape_id", "vid", F.when(F.col("z") > 0.5, 1).when(F.col("z") < -0.5, 2).when(F.col("vid") % 50 == 0, 3).alias("label"))
    pv, pf = parcels.apply_parcellation(v, f, labels)
    got = {r.label: r for r in parcels.summary(pv, pf).collect()}
    assert set(got) == {1, 2} and got[1].n_vertices == labels.where("label = 1").count()
    assert set(parcels.apply_parcellation(v, f, labels, [1])[0].select("label").distinct().toPandas()["label"]) == {2}
    values = v.select("shape_id", "vid", F.col("x").alias("value"))
    same = parcels.carried(values, v, v.drop("shape_id")).join(values.withColumnRenamed("value", "was"), ["shape_id", "vid"])
    assert same.where("value <> was").count() == 0 and same.count() == v.count()


def test_cohort_files(spark, tmp_path):
    rng, base = np.random.default_rng(6), np.arange(12.0)
    for i in range(8):
        grp = "control" if i < 4 else "patient"
        values = base + 0.1 * rng.standard_normal(12) + (i >= 4) * (np.arange(12) < 5)
        folder = tmp_path / f"sub-{i:02d}" / "anat"
        folder.mkdir(parents=True)
        one = spark.createDataFrame([(f"sub-{i:02d}_group-{grp}_hemi-L_thickness.shape", "value", j, float(x)) for j, x in enumerate(values)], "shape_id string, field string, vid long, value double")
        formats.save(formats.encode_fields(one), str(folder), "gii")
    (tmp_path / "sub-08" / "anat").mkdir(parents=True)
    (tmp_path / "sub-08" / "anat" / "sub-08_group-patient_hemi-L_thickness.shape.gii").write_bytes(b"broken")
    people = group.subjects(spark, str(tmp_path), "*thickness.shape.gii").cache()
    assert people.count() == 9 and people.where("n_files = 1").count() == 9
    assert group.subjects(spark, str(tmp_path), "*thickness.shape.gii", ["00", "sub-03"]).count() == 2
    maps, errors = group.load_group(people)
    maps = maps.cache()
    assert maps.count() == 96 and [r.subject for r in errors.collect()] == ["sub-08"]
    labels = group.covariate(people, "group")
    assert {r.value for r in labels.collect()} == {"control", "patient"}
    assert group.covariate(people, "age", "none").where("value = 'none'").count() == 9
    for test in ("ttest", "mannwhitney"):
        assert group.comparison(maps, labels, test).count() == 12
    hit = {r.vid for r in group.comparison(maps, labels).where("significant").collect()}
    assert hit == set(range(5))
    with pytest.raises(ValueError, match="two groups"):
        group.split(labels.withColumn("value", F.lit("one")))
    with pytest.raises(ValueError, match="unknown test"):
        group.comparison(maps, labels, "other")
    assert group.load_group(people.where("subject = 'none'"))[0].count() == 0


def test_freesurfer_cohort(spark, tmp_path):
    rng = np.random.default_rng(7)
    points = rng.standard_normal((12, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for s in ("s1", "s2"):
        surf = tmp_path / s / "surf"
        surf.mkdir(parents=True)
        turn = rng.permutation(12)
        (surf / "lh.sphere.reg").write_bytes(b"\xff\xff\xfemade\n\n" + struct.pack(">ii", 12, 1) + points[turn].astype(">f4").tobytes() + np.array([0, 1, 2], ">i4").tobytes())
        (surf / "lh.thickness").write_bytes(b"\xff\xff\xff" + struct.pack(">iii", 12, 1, 1) + turn.astype(">f4").tobytes())
    target = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    maps, errors = group.load_freesurfer(spark, str(tmp_path), "thickness", target)
    got = maps.collect()
    assert len(got) == 24 and all(r.value == r.vid for r in got) and errors.count() == 0
    assert group.freesurfer_subjects(spark, str(tmp_path), "thickness", wanted=["s1"]).count() == 1


def test_tract_masks(spark, tmp_path):
    def nifti(volume):
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
        struct.pack_into("<hh", head, 70, 16, 32)
        struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
        struct.pack_into("<f", head, 108, 352.0)
        struct.pack_into("<hh", head, 252, 0, 1)
        for r in range(3):
            row = [0.0] * 4
            row[r], row[3] = 2.0, 1.0
            struct.pack_into("<4f", head, 280 + 16 * r, *row)
        head[344:348] = b"n+1\0"
        return bytes(head) + volume.astype("<f4").tobytes(order="F")

    at = np.indices((12, 12, 12)) - 6
    ball = (np.square(at).sum(axis=0) <= 16).astype(float)
    for sub in ("sub-01", "sub-02"):
        folder = tmp_path / sub / "tractseg_output" / "bundle_segmentations"
        folder.mkdir(parents=True)
        (folder / "CST_left.nii").write_bytes(nifti(ball))
        (folder / "AF_left.nii").write_bytes(nifti(0 * ball))
    masks = group.tract_masks(spark, str(tmp_path))
    assert {(r.subject, r.bundle) for r in masks.collect()} == {(s, b) for s in ("sub-01", "sub-02") for b in ("CST_left", "AF_left")}
    clouds, empty = group.tract_clouds(spark, str(tmp_path))
    n = {r["count"] for r in clouds.groupBy("shape_id").count().collect()}
    assert n == {int(ball.sum())} and empty.count() == 2
    centre = clouds.agg(F.avg("x")).first()[0]
    assert abs(centre - 13.0) < 1e-9  # 2 * 6 + 1
    assert group.tract_clouds(spark, str(tmp_path), ["CST_left"])[1].count() == 0


def test_classifiers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 2), [float(x) for x in rng.standard_normal(3) + np.array([1.5 * (i % 2), 0, 0])]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, f array<double>").cache()
    r = learn.classify(df, "logistic", 2).first()
    assert 0.7 < r.accuracy <= 1 and 0.8 < r.auc <= 1
    assert learn.importance(df, "svm").orderBy(F.desc("importance")).first().feature == 0
    both = learn.compare_methods(df, df.withColumn("f", F.slice("f", 2, 2)), 2).first()
    assert both.delong_auc_a > both.delong_auc_b and both.effect > 0
    long = df.select(F.col("id").alias("subject"), F.explode(F.array(F.struct(F.lit("good").alias("descriptor"), F.col("f")[0].alias("value")), F.struct(F.lit("poor").alias("descriptor"), F.col("f")[1].alias("value")))).alias("e"), F.lit(0).alias("vid")).select("subject", "e.descriptor", "vid", "e.value")
    ranks = learn.rank_descriptors(long, df.select(F.col("id").alias("subject"), "label"), 2).orderBy(F.desc("score")).collect()
    assert ranks[0].descriptor == "good" and ranks[0].effect > 1


def test_examples_have_their_effects(spark):
    m = resample.normative_example(spark, 300, 4)
    assert -0.03 < m.where("vid = 3").agg(F.regr_slope("value", "age")).first()[0] < -0.015
    e, net = resample.connectome_example(spark, 20, 20, 4)
    inside = e.join(net.toDF("i", "a"), "i").join(net.toDF("j", "b"), "j").where("a = b").groupBy("grp").agg(F.avg("w").alias("w")).orderBy("grp").collect()
    assert abs(inside[0].w - inside[1].w - 0.3) < 0.05 and e.where("i >= j").count() == 0
    d = resample.laterality_example(spark, 60, 9).where("grp = 1").groupBy("feature").agg(F.avg(F.col("left") - F.col("right")).alias("d")).orderBy("feature").collect()
    assert all(abs(r.d - (0.3 if r.feature < 3 else 0)) < 0.1 for r in d)


def test_labels(spark):
    assert atlas.resolve_atlas("Schaefer-200")[0] == atlas.resolve_atlas("schaefer")[0] == "schaefer_200"
    with pytest.raises(ValueError, match="unknown atlas"):
        atlas.resolve_atlas("none")
    one = spark.createDataFrame([(17, "hippocampus"), (9999, "nowhere"), (None, None)], "n int, s string")
    got = one.select(atlas.label_name(F.col("n"), "aseg").alias("a"), atlas.label_id(F.col("s"), "aseg").alias("b"), atlas.label_name(F.col("n"), "none").alias("c")).collect()
    assert [tuple(r) for r in got] == [("Left-Hippocampus", 17, "Unknown-17"), ("Unknown-9999", None, "Unknown-9999"), (None, None, None)]
    assert atlas.structures(spark, "thalamic_nuclei", "right").count() == 26 and atlas.labels(spark, "none").count() == 0
    assert atlas.LABELS["hippocampal_subfields"][1208] == "CA1-head" and atlas.LABELS["amygdala_nuclei"][8001] == "Right-Lateral-nucleus"


def test_mmd_takes_each_parcel_once_by_products(spark, monkeypatch):
    import numpy as np

    from eigenlake.operators import compare

    x = np.random.default_rng(0).standard_normal((40, 5)) + 100
    plain = lambda a, b: np.exp(-np.square(a[:, None] - b[None]).sum(axis=2) / 2).mean()
    assert abs(compare._gaussian_mean(x[:15], x[15:], 1.0) - plain(x[:15], x[15:])) < 1e-12
    monkeypatch.setattr(compare, "squared", None)  # no pass a component
    assert abs(compare.mmd(x[:15], x[15:], 1.0) - np.sqrt(plain(x[:15], x[:15]) + plain(x[15:], x[15:]) - 2 * plain(x[:15], x[15:]))) < 1e-9
