"""Harmonisation with covariates and Bayesian models by recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.operators import bayes, harmonise


def test_harmonisation_keeps_the_covariate(spark):
    draw = np.random.default_rng(1)
    age = draw.uniform(20, 80, 60)
    rows = [(i, i % 2, f, float(0.1 * age[i] + 3 * (i % 2) + draw.normal(0, 0.3))) for i in range(60) for f in range(3)]
    df = spark.createDataFrame(rows, "subject int, site int, feature int, value double")
    cov = spark.createDataFrame([(i, float(a)) for i, a in enumerate(age)], "subject int, age double")
    for out in (harmonise.combat(df, cov), harmonise.combat_gam(df, cov, "age")):
        out = out.join(cov, "subject").cache()
        gap = out.groupBy("site").agg(F.avg(F.col("harmonised") - 0.1 * F.col("age")).alias("m"), F.corr("harmonised", "age").alias("r")).orderBy("site").collect()
        assert abs(gap[0].m - gap[1].m) < 0.5 and all(r.r > 0.95 for r in gap)
        assert out.count() == 180


def test_splines_sum_to_one(spark):
    basis = harmonise.bspline_basis("x", 0.0, 10.0, 7)
    s = spark.range(101).select((F.col("id") / 10).alias("x")).select(sum(basis[1:], basis[0]).alias("s"))
    assert all(abs(r.s - 1) < 1e-12 for r in s.collect())


def test_horseshoe_finds_the_two(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(80, 6))
    y = x @ [2, 0, 0, -1.5, 0, 0] + draw.normal(0, 0.5, 80) + 1
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double")
    s = {r.parameter: r for r in bayes.summary(bayes.horseshoe(df, 400, 200, 2)).collect()}
    top = sorted(range(6), key=lambda i: -abs(s[f"beta_{i}"].mean))[:2]
    assert set(top) == {0, 3} and abs(s["beta_0"].mean - 2) < 0.3 and abs(s["alpha"].mean - 1) < 0.3
    assert s["beta_0"].r_hat < 1.1


def test_groups_and_sites(spark):
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([("a" if i < 30 else "b", float(draw.normal(1.5 if i < 30 else 0, 1))) for i in range(60)], "grp string, value double")
    d = bayes.best(df, "a", "b", 400, 200, 2).cache()
    r = bayes.rope(d).first()
    assert abs(r.below + r.within + r.above - 1) < 1e-9 and r.above > 0.95
    with pytest.raises(ValueError):
        bayes.best(df, "a", "none")
    sites = spark.createDataFrame([(i % 3, float(draw.normal(2 * (i % 3), 1))) for i in range(150)], "site int, value double")
    s = {r.parameter: r.mean for r in bayes.summary(bayes.site_intercepts(sites, 400, 200, 2)).collect()}
    assert s["u_0"] < s["u_1"] < s["u_2"] and abs(s["sigma"] - 1) < 0.2


def test_normative_curve(spark):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(i % 40), float(np.sin(i % 40 / 6) + draw.normal(0, 0.1))) for i in range(200)], "id int, age double, value double")
    curve = bayes.gp_normative(df).cache()
    assert curve.where(F.abs(F.col("mean") - F.sin(F.col("age") / 6)) > 0.2).count() == 0
    assert bayes.deviation(df, curve).count() == 200
