"""Signals on graphs, tables behind figures and Bayesian effects against planted structure and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.operators import bayes, figures, resample, signals


@pytest.fixture(scope="module")
def ladder(spark):
    """Two cliques joined by one edge; a field that is high on the first one."""
    e = [(a, b) for block in (range(8), range(8, 16)) for a in block for b in block if a < b] + [(7, 8)]
    edges = spark.createDataFrame([("g", *p) for p in e], "shape_id string, u long, v long").cache()
    rng = np.random.default_rng(0)
    f = [[float(x) for x in (1.0 + 3.0 * (i < 8)) * np.array([1, 2, 3, 2]) + 0.1 * rng.random(4)] for i in range(16)]
    return spark.createDataFrame([("g", i, x) for i, x in enumerate(f)], "shape_id string, vid long, f array<double>").cache(), edges


def parted(df):
    label = [r.label for r in df.orderBy("vid").collect()]
    return len(set(label[:8])) == 1 and len(set(label[8:])) == 1 and label[0] != label[-1]


def test_clusters_of_signals(ladder):
    assert parted(signals.cluster_views(*ladder, k=2, modes=1)) and parted(signals.cluster_views(*ladder, k=2, modes=1, fusion="concatenate"))
    out = signals.auto_cluster(*ladder, {"views": "views", "own": lambda d, e: d.withColumn("label", F.lit(0))}, k=2)
    assert out.where("method = 'own'").count() == 16 and out.count() == 32
    for f in (signals.cluster_bands, signals.cluster_wavelets):
        assert f(*ladder, k=2).count() == 16
    with pytest.raises(ValueError, match="unknown fusion"):
        signals.cluster_views(*ladder, fusion="other")


def test_denoising_keeps_constants(spark, ladder):
    d, e = ladder
    flat = d.withColumn("f", F.transform("f", lambda x: F.lit(2.5)))
    got = np.array([r.f for r in signals.denoise_joint(flat, e).collect()])
    assert np.allclose(got, 2.5)
    rough = np.array([r.f for r in d.orderBy("vid").collect()])
    smooth = np.array([r.f for r in signals.denoise_joint(d, e).orderBy("vid").collect()])
    assert np.abs(np.diff(smooth[:7], axis=0)).sum() < np.abs(np.diff(rough[:7], axis=0)).sum()  # 7 has a neighbour beyond
    assert np.allclose(signals._cosines(6).T @ signals._cosines(6), np.eye(6))
    same = np.array([r.f for r in signals.denoise_joint(d, e, 0.0, 0.0).orderBy("vid").collect()])
    assert np.allclose(same, rough)


def test_factors(spark):
    rng = np.random.default_rng(1)
    w, h = rng.random((30, 2)), rng.random((2, 12))
    x = w @ h
    df = spark.createDataFrame([("s", i, r[:6].tolist(), r[6:].tolist()) for i, r in enumerate(x)], "shape_id string, vid long, f array<double>, g array<double>")
    got = np.array([r.f for r in signals.joint_factors(df.select("shape_id", "vid", "f"), df.select("shape_id", "vid", F.col("g").alias("f")), 2, 2000, 1e-9).orderBy("vid").collect()])
    y = x / x.max(axis=0)
    fit = got @ np.linalg.lstsq(got, y, rcond=None)[0]
    assert np.abs(fit - y).max() < 0.05
    a, b, c = rng.random((5, 2)), rng.random((6, 2)), rng.random((7, 2))
    t = np.einsum("ic,jc,kc->ijk", a, b, c)
    rows = spark.createDataFrame([("t", i, j, t[i, j].tolist()) for i in range(5) for j in range(6)], "shape_id string, subject long, vid long, f array<double>")
    out = signals.tensor_factors(rows, 2, 2000, 1e-12).collect()
    part = {m: np.zeros((n, 2)) for m, n in (("subject", 5), ("vertex", 6), ("scale", 7))}
    for r in out:
        part[r["mode"]][r["at"], r["component"]] = r["value"]
    assert np.abs(np.einsum("ic,jc,kc->ijk", part["subject"], part["vertex"], part["scale"]) - t).max() < 0.02


def test_vines(spark):
    """Two peaks on a path; the second is gone in the second half of the scales."""
    rows = []
    for t in range(10):
        y = np.zeros(20)
        y[4], y[15] = 5.0, (3.0 if t < 5 else 0.0)
        y[[3, 5]] = 1.0
        rows += [("g", i, t, float(v)) for i, v in enumerate(y)]
    fields = spark.createDataFrame(rows, "shape_id string, vid long, t int, value double")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(19)], "shape_id string, u long, v long")
    got = {}
    for r in signals.vines(fields, edges).orderBy("vine", "t").collect():
        got.setdefault(r.vine, []).append((r.t, r.vid, r.birth, r.death))
    assert sorted(len(v) for v in got.values()) == [5, 10]
    assert {v[0][1:] for v in got.values()} == {(4, 5.0, 0.0), (15, 3.0, 0.0)}


def test_intervals_and_curves(spark):
    draws = spark.createDataFrame([("a", float(x)) for x in [0, 1, 2, 3, 100]] + [("b", 1.0)], "parameter string, value double")
    got = {r.parameter: (r.low, r.high, r.n) for r in figures.intervals(draws, "value", 0.8, "parameter").collect()}
    assert got == {"a": (0.0, 3.0, 5), "b": (1.0, 1.0, 1)}
    d = figures.density(draws, "value", 200, None, "parameter")
    assert d.where("parameter = 'b'").count() == 0
    rows = d.orderBy("x").collect()
    assert abs(np.trapezoid([r.density for r in rows], [r.x for r in rows]) - 1) < 0.01
    h = figures.histogram(draws, "value", 4, 0.0, 4.0, "parameter")
    assert {(r.bin, r.n) for r in h.where("parameter = 'a'").collect()} == {(0, 1), (1, 1), (2, 1), (3, 1)}
    assert figures.histogram(draws.where("value = 1"), "value").where("bin = 0 and n = 2").count() == 1
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (None, 0.3)], "y int, s double")
    assert figures.area_under(s).first().auc == 0.625
    assert {(r.threshold, r.fpr, r.tpr) for r in figures.roc_curve(s).collect()} == {(0.9, 0.5, 0.5), (0.5, 0.5, 1.0), (0.1, 1.0, 1.0)}


def test_line_over_a_surface(spark):
    v = spark.createDataFrame([("s", 0, 0.0, 0.0, 1.0), ("s", 1, 1.0, 0.0, 2.0), ("s", 2, 1.0, 1.0, 4.0), ("s", 3, 0.0, 1.0, 3.0)], "shape_id string, vid long, x double, y double, value double")
    f = spark.createDataFrame([("s", 0, 0, 1, 2), ("s", 1, 0, 2, 3)], "shape_id string, fid long, i0 long, i1 long, i2 long")
    got = [r.value for r in figures.along_line(v, f, (0.0, 0.5), (2.0, 0.5), 5).orderBy("i").collect()]
    assert np.allclose(got[:3], [2.0, 2.5, 3.0]) and got[3:] == [None, None]  # 1 + x + 2 y


def test_agreement(spark):
    rows = [(m, i, int(l)) for m, labels in (("p", [0, 0, 1, 1, 2, 2]), ("q", [5, 5, 3, 3, 4, 4]), ("r", [0, 1, 0, 1, 0, 1])) for i, l in enumerate(labels)]
    got = {(r.a, r.b): r.ari for r in figures.agreement(spark.createDataFrame(rows, "method string, vid long, label int")).collect()}
    assert got["p", "q"] == 1.0 and got["p", "r"] < 0.05 and len(got) == 3
    m = spark.createDataFrame([("x", [1.0, 2.0, 4.0]), ("y", [2.0, 4.0, 8.0]), ("z", [-1.0, -2.0, -4.0])], "name string, v array<double>")
    assert {(r.a, r.b): round(r.r, 9) for r in figures.agreement_of_matrices(m).collect()} == {("x", "y"): 1.0, ("x", "z"): -1.0, ("y", "z"): -1.0}


def test_bayesian_effects(spark):
    edges, net = resample.connectome_example(spark, 40, 8, 2, 0.3)
    got = {r.name: r.mean for r in bayes.effects(bayes.edge_differences(edges.withColumn("grp", F.col("grp").cast("string")), "0", "1", 300, 100, 2), "diff_").collect()}
    inside = [v for k, v in got.items() if (int(k.split("_")[0]) < 4) == (int(k.split("_")[1]) < 4)]
    across = [v for k, v in got.items() if (int(k.split("_")[0]) < 4) != (int(k.split("_")[1]) < 4)]
    assert len(got) == 28 and abs(np.mean(inside) + 0.3) < 0.06 and abs(np.mean(across)) < 0.06
    m = spark.range(40).select(F.col("id").alias("subject"), F.when(F.col("id") < 20, "a").otherwise("b").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("vid"))
    m = m.select("subject", "grp", F.col("vid").cast("long").alias("vid"), (resample.normal(3, "subject", "vid") + F.when((F.col("grp") == "b") & (F.col("vid") < 10), 2.0).otherwise(0.0)).alias("value"))
    chain = spark.range(19).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    e = {int(r.name): r.mean for r in bayes.effects(bayes.spatial_effect(m, chain, "a", "b", draws=200, tune=100, chains=2)).collect()}
    assert np.mean([e[i] for i in range(9)]) > 1.4 and abs(np.mean([e[i] for i in range(11, 20)])) < 0.5
    draws = spark.createDataFrame([(0, d, p, v) for d in range(2) for p, v in (("beta_0", 1.0 + d), ("beta_1", -1.0), ("alpha", 0.5))], "chain int, draw int, parameter string, value double")
    r = bayes.predict(draws, spark.createDataFrame([(7, [2.0, 1.0])], "id int, x array<double>")).first()
    assert (r.id, r.mean) == (7, 2.5) and abs(r.sd - 2**0.5) < 1e-12
    assert {x.feature: x.importance for x in bayes.importance(draws).collect()} == {0: 1.5, 1: 1.0}
