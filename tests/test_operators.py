"""Analytic truths of the operators."""

import math

from eigenlake.functions import names
from eigenlake.operators import cohort, distribution, geometry


def test_torus(spark):
    vertices, faces = geometry.torus(spark, 60, 40)
    r = geometry.topology(vertices, faces).first()
    assert (r.euler, r.genus, r.closed) == (0, 1, True)
    area = geometry.surface_area(vertices, faces).first().area
    assert abs(area / (4 * math.pi**2 * 40 * 15) - 1) < 0.02
    assert abs(sum(x.w for x in geometry.cotangent_laplacian(vertices, faces).collect())) < 1e-8
    k, a = (geometry.gaussian_curvature(vertices, faces), geometry.vertex_areas(vertices, faces))
    assert abs(sum(x.curvature * x.area for x in k.join(a, ["shape_id", "vid"]).collect())) < 1e-6


def test_identical_scores_have_no_difference(spark):
    rows = [(i % 2, float(i * 7 % 13), float(i * 7 % 13)) for i in range(40)]
    r = cohort.delong(spark.createDataFrame(rows, "y int, s_a double, s_b double")).first()
    assert r.auc_a == r.auc_b and r.z == 0


def test_energy_distance_equals_pairs(spark):
    a, b = [0.0, 1.0, 2.5], [0.5, 0.5, 4.0, 7.0]
    mean = lambda x, y: sum(abs(p - q) for p in x for q in y) / len(x) / len(y)
    df = spark.createDataFrame([(0, x) for x in a] + [(1, x) for x in b], "g int, x double")
    assert abs(distribution.energy_1d(df, 0, 1).first().distance - (2 * mean(a, b) - mean(a, a) - mean(b, b))) < 1e-12


def test_constant_groups_have_zero_t(spark):
    df = spark.createDataFrame([(g, 1, 2.0) for g in "AABB"], "grp string, vid int, value double")
    assert cohort.ttest(df, "A", "B").first().t == 0


def test_names(spark):
    df = spark.createDataFrame([("sub-01_hemi-L_x.surf.gii",), ("a.nii.gz",), ("b.txt",), (None,)], "p string")
    assert [r[0] for r in df.select(names.geometry_format(df["p"])).collect()] == ["gifti", "nifti", None, None]
    assert df.select(names.bids_entities(df["p"])).first()[0] == {"sub": "01", "hemi": "L"}
