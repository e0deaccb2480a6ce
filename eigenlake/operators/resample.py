"""Bootstraps, null models and synthetic data; draws depend on the seed and the replicate's number alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import nearest, per_shape, xyz


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1) from keys and seed."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number from keys and seed."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit("r")))) * F.cos(2 * np.pi * uniform(seed, *keys, F.lit("a")))


def bootstrap_mean(sample: DataFrame, replicates: int = 10_000, ci: float = 0.95, seed: int = 0, method: str = "percentile") -> DataFrame:
    """(mean, low, high) of a sample (id, value) by the Poisson bootstrap.

    Each row enters each replicate a Poisson number of times, drawn from its
    id and the replicate, so a task sums its own rows for all replicates and
    only replicates x tasks sums meet; the result doesn't depend on partitions.
    bca corrects bias and skew by the jackknife, whose sums are moments.
    """
    rows = sample.select("id", F.col("value").cast("double").alias("value")).dropna()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            for key, value in zip(b["id"], b["value"], strict=True):
                w = np.random.Generator(np.random.Philox(key=[seed, int(key) & (2**64 - 1)])).poisson(1.0, replicates)
                s += w * value
                n += w
        yield pd.DataFrame({"b": np.arange(replicates), "s": s, "n": n})

    per = rows.mapInPandas(partial, "b int, s double, n double").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    stats = rows.agg(F.avg("value").alias("mean"), F.avg(F.pow(F.col("value"), F.lit(2.0))).alias("m2"), F.avg(F.pow(F.col("value"), F.lit(3.0))).alias("m3"), F.count("*").alias("n")).first()
    tail = (1 - ci) / 2
    low, high = tail, 1 - tail
    if method == "bca" and stats["n"] > 1:
        from statistics import NormalDist

        z, below = NormalDist(), per.agg(F.avg((F.col("m") < stats["mean"]).cast("double")), F.avg((F.col("m") == stats["mean"]).cast("double"))).first()
        bias = z.inv_cdf(min(max(below[0] + below[1] / 2, 1e-6), 1 - 1e-6))
        var = max(stats["m2"] - stats["mean"] ** 2, 1e-300)
        skew = stats["m3"] - 3 * stats["mean"] * stats["m2"] + 2 * stats["mean"] ** 3
        a = skew / (6 * var**1.5 * stats["n"] ** 0.5)
        shift = lambda p: z.cdf(bias + (bias + z.inv_cdf(p)) / (1 - a * (bias + z.inv_cdf(p))))
        low, high = shift(tail), shift(1 - tail)
    return per.agg(F.lit(stats["mean"]).cast("double").alias("mean"), F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))


def bootstrap_paired_difference(pairs: DataFrame, replicates: int = 10_000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """The same for a - b of pairs (id, a, b)."""
    return bootstrap_mean(pairs.select("id", (F.col("a") - F.col("b")).alias("value")), replicates, ci, seed)


def null_labels(subjects: DataFrame, surrogates: int, seed: int = 0) -> DataFrame:
    """(surrogate, subject, label): labels (subject, label) dealt anew; group sizes stay."""
    from pyspark.sql import Window

    w = subjects.sparkSession.range(surrogates).withColumnRenamed("id", "surrogate")
    every = subjects.crossJoin(w)  # the result is every subject in every surrogate
    own, dealt = Window.partitionBy("surrogate").orderBy("subject"), Window.partitionBy("surrogate").orderBy(uniform(seed, "surrogate", "subject"), "subject")
    ranked = every.withColumn("i", F.row_number().over(own)).withColumn("j", F.row_number().over(dealt))
    return ranked.select("surrogate", "i", "label").join(ranked.select("surrogate", "subject", F.col("j").alias("i")), ["surrogate", "i"]).select("surrogate", "subject", "label")


def null_eigenvalues(values: DataFrame, surrogates: int, seed: int = 0) -> DataFrame:
    """(surrogate, shape_id, k, lambda): eigenvalues (shape_id, k, lambda) dealt to other places of the shape."""
    rows = F.sort_array(F.collect_list(F.struct("k", "lambda")))
    each = values.groupBy("shape_id").agg(rows.alias("r")).crossJoin(values.sparkSession.range(surrogates).withColumnRenamed("id", "surrogate"))
    dealt = F.array_sort(F.transform("r", lambda x: F.struct(uniform(seed, F.col("surrogate"), F.col("shape_id"), x["k"]).alias("u"), x["lambda"].alias("l"))))
    return each.select("surrogate", "shape_id", F.explode(F.zip_with("r", dealt, lambda a, b: F.struct(a["k"].alias("k"), b["l"].alias("lambda")))).alias("x")).select("surrogate", "shape_id", "x.*")


def null_phase(coefficients: DataFrame, eig: DataFrame, surrogates: int, seed: int = 0) -> DataFrame:
    """(surrogate, shape_id, vid, value): a field rebuilt from spectral coefficients (shape_id, k, c), each times the cosine of a random phase."""
    s = coefficients.sparkSession.range(surrogates).withColumnRenamed("id", "surrogate")
    c = coefficients.crossJoin(s).withColumn("c", F.col("c") * F.cos(2 * np.pi * uniform(seed, "surrogate", "shape_id", "k")))
    c = c.groupBy("surrogate", "shape_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("c"))
    value = F.aggregate(F.zip_with("phi", "c", lambda p, q: p * q), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return eig.join(c, "shape_id").select("surrogate", "shape_id", "vid", value.alias("value"))


def null_spin(field: DataFrame, surrogates: int, seed: int = 0) -> DataFrame:
    """(surrogate, shape_id, vid, value): values of a field on a sphere (shape_id, vid, x, y, z, value) under random rotations, from the nearest turned vertex."""
    s = field.sparkSession.range(surrogates).withColumnRenamed("id", "surrogate")
    keyed = field.crossJoin(s).withColumn("shape_id", F.struct("shape_id", "surrogate"))

    def run(r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("vid", ignore_index=True)
        n = int(r["surrogate"].iloc[0])
        q, t = np.linalg.qr(np.random.default_rng([seed, n]).standard_normal((3, 3)))
        q = q * np.sign(np.diag(t))
        q[:, 0] *= np.sign(np.linalg.det(q))
        at = nearest(xyz(r) @ q.T, 1, xyz(r))[0][:, 0]
        return pd.DataFrame({"surrogate": n, "shape_id": r["shape"], "vid": r["vid"], "value": r["value"].to_numpy()[at]})

    kind = field.schema["shape_id"].dataType.simpleString()
    flat = keyed.select(F.col("shape_id.shape_id").alias("shape"), "surrogate", "vid", "x", "y", "z", F.col("value").cast("double").alias("value"))
    return flat.groupBy("shape", "surrogate").applyInPandas(run, f"surrogate long, shape_id {kind}, vid long, value double")


def null_rewired(edges: DataFrame, surrogates: int, swaps_per_edge: int = 10, seed: int = 0) -> DataFrame:
    """(surrogate, i, j, w): undirected edges (i, j, w) after swaps of ends that keep every degree; swaps that would make a loop or a double edge are left out.

    Each surrogate is one task that gets the whole connectome.
    """
    e = edges.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.col("w").cast("double").alias("w")).where("i <> j").crossJoin(edges.sparkSession.range(surrogates).withColumnRenamed("id", "shape_id"))

    def kernel(r):
        i, j = r["i"].to_numpy().copy(), r["j"].to_numpy().copy()
        have, draw, n = set(zip(i.tolist(), j.tolist(), strict=True)), np.random.default_rng([seed, int(r["shape_id"].iloc[0])]), len(r)
        for a, b in draw.integers(0, n, (n * swaps_per_edge, 2)).tolist() if n > 1 else ():
            p, q = (min(i[a], j[b]), max(i[a], j[b])), (min(i[b], j[a]), max(i[b], j[a]))
            if a == b or p[0] == p[1] or q[0] == q[1] or p == q or p in have or q in have:
                continue
            have -= {(i[a], j[a]), (i[b], j[b])}
            have |= {p, q}
            (i[a], j[a]), (i[b], j[b]) = p, q
        return {"i": i, "j": j, "w": r["w"]}

    return per_shape(e, kernel, "i long, j long, w double", order=["i", "j"]).withColumnRenamed("shape_id", "surrogate")


def null_parametric(moments: DataFrame, surrogates: int, seed: int = 0) -> DataFrame:
    """(surrogate, vid, value): normal values with each vertex's moments (vid, mean, std)."""
    every = moments.crossJoin(moments.sparkSession.range(surrogates).withColumnRenamed("id", "surrogate"))
    return every.select("surrogate", "vid", (F.col("mean") + F.col("std") * normal(seed, "surrogate", "vid")).alias("value"))


# ---- synthetic data, generated by the cluster


def uv_sphere(spark: SparkSession, n_lat: int = 30, n_lon: int = 60, radii: tuple[float, float, float] = (50.0, 50.0, 50.0)) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a closed ellipsoid with one vertex at each pole; shape_id is ``ellipsoid``."""
    inner = n_lat - 1
    last = inner * n_lon + 1
    k = F.col("id") - 1
    theta, phi = np.pi * (F.floor(k / n_lon) + 1) / n_lat, 2 * np.pi * (k % n_lon) / n_lon
    theta = F.when(F.col("id") == 0, 0.0).when(F.col("id") == last, np.pi).otherwise(theta)
    a, b, c = map(float, radii)
    v = spark.range(last + 1).select(F.lit("ellipsoid").alias("shape_id"), F.col("id").alias("vid"), (a * F.sin(theta) * F.cos(phi)).alias("x"), (b * F.sin(theta) * F.sin(phi)).alias("y"), (c * F.cos(theta)).alias("z"))
    i, j = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
    at = lambda p, q: 1 + (p * n_lon + q % n_lon)
    tri = lambda *x: F.array(*(y.cast("long") for y in x))
    upper = F.when(i == 0, tri(F.lit(0), at(F.lit(0), j), at(F.lit(0), j + 1))).otherwise(F.when(i < n_lat - 1, tri(at(i - 1, j), at(i, j), at(i, j + 1))))
    lower = F.when(i == n_lat - 1, tri(F.lit(last), at(F.lit(inner - 1), j + 1), at(F.lit(inner - 1), j))).otherwise(F.when(i > 0, tri(at(i - 1, j), at(i, j + 1), at(i - 1, j + 1))))
    f = spark.range(n_lat * n_lon).select(F.explode(F.array(F.struct((2 * F.col("id")).alias("fid"), upper.alias("t")), F.struct((2 * F.col("id") + 1).alias("fid"), lower.alias("t")))).alias("q")).where("q.t is not null")
    return v, f.select(F.lit("ellipsoid").alias("shape_id"), "q.fid", *(F.get("q.t", F.lit(c)).alias(f"i{c}") for c in range(3)))


def random_cloud(spark: SparkSession, n: int = 1000, kind: str = "sphere", radii: tuple[float, float, float] = (50.0, 50.0, 50.0), clusters: int = 5, spread: float = 30.0, std: float = 5.0, noise: float = 0.5, seed: int = 0) -> DataFrame:
    """Points on an ellipsoid (``sphere``), a Gaussian ``blob`` of deviations ``radii``, or a mixture (``multi_cluster``, with the column cluster)."""
    p = spark.range(n).select(F.lit(kind).alias("shape_id"), F.col("id").alias("vid"), *(normal(seed, "id", F.lit(c)).alias(c) for c in "xyz"))
    if kind == "blob":
        return p.select("shape_id", "vid", *((F.col(c) * r).alias(c) for c, r in zip("xyz", radii, strict=True)))
    if kind == "multi_cluster":
        c = F.pmod("vid", F.lit(clusters))
        return p.select("shape_id", "vid", c.alias("cluster"), *((F.col(x) * std + spread * normal(seed + 1, c, F.lit(x))).alias(x) for x in "xyz"))
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return p.select("shape_id", "vid", *((F.col(c) / length * r + noise * normal(seed + 1, "vid", F.lit(c))).alias(c) for c, r in zip("xyz", radii, strict=True)))


def random_maps(spark: SparkSession, subjects: int = 20, vertices: int = 500, scales: int = 10, effect: float = 0.5, share: float = 0.2, seed: int = 0) -> DataFrame:
    """(subject, grp, vid, t, value): two groups of equal size; group b is ``effect`` higher on the first ``share`` of the vertices."""
    p = spark.range(subjects * vertices * scales).select(F.floor(F.col("id") / (vertices * scales)).alias("subject"), (F.floor(F.col("id") / scales) % vertices).alias("vid"), (F.col("id") % scales).cast("int").alias("t"))
    grp = F.when(F.col("subject") % 2 == 0, "a").otherwise("b")
    return p.select("subject", grp.alias("grp"), "vid", "t", (normal(seed, "subject", "vid", "t") + F.when((grp == "b") & (F.col("vid") < share * vertices), effect).otherwise(0.0)).alias("value"))


def normative_example(spark: SparkSession, subjects: int = 200, vertices: int = 500, ages: tuple[float, float] = (20.0, 80.0), seed: int = 0) -> DataFrame:
    """(subject, vid, age, sex, value): maps that fall with age, more so at higher vid, and are 0.1 higher for sex 1."""
    s = spark.range(subjects).select(F.col("id").alias("subject"), (ages[0] + (ages[1] - ages[0]) * uniform(seed, "id", F.lit("age"))).alias("age"), (uniform(seed, "id", F.lit("sex")) < 0.5).cast("int").alias("sex"))
    at = s.withColumn("vid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vertices - 1).cast("long"))))
    slope = 0.005 + 0.015 * F.col("vid") / max(vertices - 1, 1)
    return at.select("subject", "vid", "age", "sex", (2.5 - slope * (F.col("age") - 50) + 0.1 * F.col("sex") + 0.2 * normal(seed, "subject", "vid")).alias("value"))


def connectome_example(spark: SparkSession, subjects: int = 40, parcels: int = 50, networks: int = 5, effect: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (subject, grp, i, j, w) with i < j, heavier within a network and less so in group 1, and networks (i, network) of consecutive parcels."""
    of = lambda c: F.least(F.floor(F.col(c) * networks / parcels), F.lit(networks - 1)).cast("int")
    node = spark.range(parcels)
    pairs = node.select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(parcels))).alias("j")).where(F.col("j") < parcels)
    at = spark.range(subjects).select(F.col("id").alias("subject"), (F.col("id") >= subjects // 2).cast("int").alias("grp")).crossJoin(F.broadcast(pairs))  # the example has these rows
    mean = F.when(of("i") == of("j"), 0.6 - effect * F.col("grp")).otherwise(0.2)
    return at.select("subject", "grp", "i", "j", (mean + 0.1 * normal(seed, "subject", "i", "j")).alias("w")), node.select(F.col("id").alias("i"), of("id").alias("network"))


def laterality_example(spark: SparkSession, subjects: int = 40, features: int = 50, asymmetry: float = 0.3, seed: int = 0) -> DataFrame:
    """(subject, grp, feature, left, right): a third of the features are larger on the left in group 1."""
    at = spark.range(subjects).select(F.col("id").alias("subject"), (F.col("id") >= subjects // 2).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"))
    side = lambda name: 1.0 + 0.1 * normal(seed, "subject", "feature", F.lit(name))
    return at.select("subject", "grp", "feature", (side("left") + F.when((F.col("feature") < features // 3) & (F.col("grp") == 1), asymmetry).otherwise(0.0)).alias("left"), side("right").alias("right"))
