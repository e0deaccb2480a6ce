"""Inference operators against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.functions import special
from eigenlake.operators import inference, order


def maps_of(spark, values, grp):
    rows = [(int(s), grp(s), int(v), float(x)) for s, row in enumerate(values) for v, x in enumerate(row)]
    return spark.createDataFrame(rows, "subject long, grp string, vid long, value double")


def test_tail_probabilities():
    t = np.array([0.0, 0.5, 1.0, 2.5, -3.0, 40.0])
    assert np.allclose(special.student_two_sided(t, np.full(6, 1.0)), 1 - 2 / np.pi * np.arctan(np.abs(t)), atol=1e-12)
    two = 1 - np.abs(t) / np.sqrt(2 + t * t)
    assert np.allclose(special.student_two_sided(t, np.full(6, 2.0)), two, atol=1e-12)
    x = np.array([0.0, 0.3, 1.0, 5.0, 30.0])
    assert np.allclose(special.upper_gamma(np.ones(5), x), np.exp(-x), atol=1e-12)
    assert np.allclose(special.upper_gamma(np.full(5, 0.5), x), [math.erfc(math.sqrt(v)) for v in x], atol=1e-12)


def test_ranks_over_the_whole_table(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 50, 500).tolist() + [None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i int, x double")
    have = {r.i: r.r for r in order.midranks(df, "x", "r").collect()}
    a = np.array(x[:-1], float)
    want = [(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a]
    assert [have[i] for i in range(500)] == want and have[500] is None


def test_permutation_finds_the_shifted_vertices(spark):
    draw = np.random.default_rng(2)
    y = draw.normal(size=(36, 40))
    y[:18, :8] += 2.0
    maps = maps_of(spark, y, lambda s: "a" if s < 18 else "b")
    out = {r.vid: r for r in inference.permutation_test(maps, "a", "b", 300, 1).collect()}
    assert all(r.p_max >= r.p - 1e-12 for r in out.values())
    found = {v for v, r in out.items() if r.significant}
    assert len(found & set(range(8))) >= 5 and not found - set(range(8))
    again = {r.vid: r.p for r in inference.permutation_test(maps.repartition(7), "a", "b", 300, 1).collect()}
    assert again == {v: r.p for v, r in out.items()}
    t = {r.vid: r.t for r in inference.vertexwise_ttest(maps, "a", "b").collect()}
    assert all(abs(t[v] - out[v].statistic) < 1e-9 for v in t)
    assert inference.permutation_test(maps.where("grp = 'a'"), "a", "b", 10).count() == 0


def test_mann_whitney_and_wilcoxon(spark):
    draw = np.random.default_rng(3)
    y = draw.integers(0, 9, (20, 5))
    maps = maps_of(spark, y, lambda s: "a" if s < 9 else "b")
    for r in inference.vertexwise_mannwhitney(maps, "a", "b").collect():
        a, b = y[:9, r.vid], y[9:, r.vid]
        assert r.u == sum((p > q) + 0.5 * (p == q) for p in a for q in b)
        assert 0 <= r.p <= r.p_corrected <= 1
    pairs = spark.createDataFrame([("f", float(a), 0.0) for a in (1, -2, 3, 4, 0)], "feature string, left double, right double")
    r = inference.asymmetry(pairs).first()
    assert (r.w_plus, r.n) == (8.0, 4)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_without_the_covariates_part(spark, method):
    draw = np.random.default_rng(4)
    c = draw.normal(size=(40, 2))
    score = c @ [2, -1] + draw.normal(size=40) * 0.5
    y = np.stack([c @ [2, -1] + draw.normal(size=40) * 0.5, score * 2 + draw.normal(size=40) * 0.1], axis=1)
    maps = maps_of(spark, y, lambda s: "a").select("subject", "vid", "value")
    scores = spark.createDataFrame([(i, float(score[i]), float(c[i, 0]), float(c[i, 1])) for i in range(40)], "subject long, score double, c1 double, c2 double")
    plain = {r.vid: r.r for r in inference.vertexwise_correlation(maps, scores, method=method).collect()}
    out = {r.vid: r for r in inference.vertexwise_correlation(maps, scores, ["c1", "c2"], method).collect()}
    assert plain[0] > 0.8 and abs(out[0].r) < 0.4 and out[1].r > 0.9
    assert out[0].df == 36
    if method == "pearson":
        x = np.column_stack([np.ones(40), c])
        left = lambda v: v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
        assert abs(out[0].r - np.corrcoef(left(y[:, 0]), left(score))[0, 1]) < 1e-9


def test_tfce_of_a_plateau(spark):
    field = spark.createDataFrame([("s", i, 1.0 if i < 4 else 0.0) for i in range(8)], "shape_id string, vid long, value double")
    edges = spark.createDataFrame([("s", i, i + 1) for i in range(7)], "shape_id string, u long, v long")
    out = {r.vid: r.tfce for r in inference.tfce(field, edges, steps=100).collect()}
    want = 2.0 * sum((k / 100) ** 2 for k in range(1, 101)) / 100
    assert abs(out[0] - want) < 1e-9 and out[0] == out[3] and out[5] == 0


def test_matrices_compare(spark):
    draw = np.random.default_rng(6)
    f = draw.normal(size=(12, 5))
    items = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(f)], "id long, f array<double>")
    noisy = spark.createDataFrame([(i, (row + 0.01 * draw.normal(size=5)).tolist()) for i, row in enumerate(f)], "id long, f array<double>")
    for metric in ("correlation", "euclidean", "cosine"):
        assert inference.rdm(items, metric).count() == 66
    c = {(r.a, r.b): r.d for r in inference.rdm(items).collect()}
    assert abs(c[0, 1] - (1 - np.corrcoef(f[0], f[1])[0, 1])) < 1e-12
    a, b = inference.rdm(items, "euclidean"), inference.rdm(noisy, "euclidean")
    assert inference.rsa_compare(a, b).first().r > 0.95
    r = inference.mantel_test(a, b, 200).first()
    assert r.r > 0.95 and r.p < 0.02


def test_margins(spark):
    draw = np.random.default_rng(7)
    ref = draw.normal(0.8, 0.02, 40)
    new = ref + draw.normal(0, 0.01, 40)
    m = spark.createDataFrame([(float(a), float(b)) for a, b in zip(new, ref)], "new double, ref double")
    paired, apart = inference.non_inferiority(m).first(), inference.non_inferiority(m, paired=False).first()
    assert paired.p < 0.025 and paired.lower > -0.05 and paired.p != apart.p
    assert inference.equivalence_tost(m).first().p < 0.05
    assert inference.equivalence_tost(m.withColumn("new", F.col("new") + 0.2)).first().p > 0.5


def test_vocabulary_features(spark):
    draw = np.random.default_rng(8)
    d = spark.createDataFrame([(i % 3, i, draw.normal(size=2).tolist()) for i in range(60)], "shape_id int, vid long, f array<double>")
    words = spark.createDataFrame([(0, [-1.0, 0.0]), (1, [1.0, 0.0])], "word int, c array<double>")
    for sigma in (None, 1.0):
        s = inference.bag_of_words(d, words, sigma).groupBy("shape_id").agg(F.sum("share").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in s)
    fv = inference.fisher_vector(d, [0.5, 0.5], [[-1.0, 0.0], [1.0, 0.0]], [[1.0, 1.0], [1.0, 1.0]]).collect()
    assert len(fv) == 3 and all(len(r.fv) == 8 and abs(sum(x * x for x in r.fv) - 1) < 1e-9 for r in fv)
    assert inference.kernel_mean_embedding(d, 1.0, 10).count() == 30


def test_percentiles_and_surprise(spark):
    norm = spark.createDataFrame([(1, float(v)) for v in (1, 2, 2, 3)], "vid long, value double")
    one = spark.createDataFrame([(1, 2.0)], "vid long, value double")
    assert inference.percentile_score(one, norm).first().percentile == 62.5
    s = spark.createDataFrame([(1, 1.0, 0.5)], "vid long, mean double, std double")
    assert abs(inference.surprise(one, s).first().z - 2) < 1e-12
