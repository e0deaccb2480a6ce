"""Point clouds (shape_id, vid, x, y, z): neighbours, density, local frames, alignment, distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import XYZ, blocks, nearest, per_pair, per_shape, squared, xyz

TINY = 1e-30


def knn_search(points: DataFrame, k: int = 20) -> DataFrame:
    """(shape_id, vid, rank, to, distance): the k nearest points of the same shape, the point itself at rank 0; equal distances by vid."""

    def kernel(p):
        at, far = nearest(xyz(p), k)
        n, m = at.shape
        ids = p["vid"].to_numpy()
        return {"vid": np.repeat(ids, m), "rank": np.tile(np.arange(m), n), "to": ids[at.ravel()], "distance": far.ravel()}

    return per_shape(points, kernel, "vid long, rank int, to long, distance double")


def radius_search(points: DataFrame, radius: float) -> DataFrame:
    """(shape_id, vid, to, distance) of all points within the radius, which counts as inside; the point itself too.

    Points meet in cells of the radius' size: a point is sent to its own and
    the 26 neighbouring cells, so the join is by key and only near points pair.
    """
    cell = [F.floor(F.col(c) / radius).cast("long") for c in XYZ]
    own = points.select("shape_id", "vid", *XYZ, *(c.alias(f"c{i}") for i, c in enumerate(cell)))
    steps = F.array(*(F.array(*(F.lit(d).cast("long") for d in (a, b, c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    sent = own.withColumn("s", F.explode(steps)).select("shape_id", F.col("vid").alias("to"), *(F.col(c).alias(f"t{c}") for c in XYZ), *((F.col(f"c{i}") + F.get("s", F.lit(i))).alias(f"c{i}") for i in range(3)))
    d2 = sum((F.pow(F.col(c) - F.col(f"t{c}"), F.lit(2.0)) for c in XYZ[1:]), F.pow(F.col("x") - F.col("tx"), F.lit(2.0)))
    return own.join(sent, ["shape_id", "c0", "c1", "c2"]).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius).select("shape_id", "vid", "to", "distance")


def knn_adjacency(points: DataFrame, k: int = 20) -> DataFrame:
    """(shape_id, i, j): binary adjacency of the k nearest, self included, either direction."""
    e = knn_search(points, k).select("shape_id", F.col("vid").alias("i"), F.col("to").alias("j"))
    return e.unionByName(e.select("shape_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def density(points: DataFrame, k: int = 6) -> DataFrame:
    """(shape_id, vid, density): k over the volume of the ball up to the k-th neighbour, the point itself being the first."""

    def kernel(p):
        _, far = nearest(xyz(p), k)
        return {"vid": p["vid"], "density": k / (4 / 3 * np.pi * np.maximum(far[:, -1], 1e-12) ** 3)}

    return per_shape(points, kernel, "vid long, density double")


def density_outliers(points: DataFrame, k: int = 6, sigma: float = 3.0) -> DataFrame:
    """(shape_id, vid, z, outlier): score of the log density within the shape, population deviation; outliers lie beyond sigma on either side."""
    d = density(points, k).withColumn("l", F.log("density"))
    s = d.groupBy("shape_id").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))
    z = (F.col("l") - F.col("m")) / (F.col("s") + TINY)
    return d.join(s, "shape_id").select("shape_id", "vid", z.alias("z"), (F.abs(z) > sigma).alias("outlier"))


def denoise(points: DataFrame, k: int = 10, sigma: float = 2.5) -> DataFrame:
    """The points that aren't density outliers."""
    return points.join(density_outliers(points, k, sigma).where("outlier").select("shape_id", "vid"), ["shape_id", "vid"], "left_anti")


def _frames(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of the covariance of each point's neighbourhood."""
    near = p[nearest(p, k)[0]]
    near = near - near.mean(axis=1, keepdims=True)
    return np.linalg.eigh(np.einsum("nki,nkj->nij", near, near) / max(near.shape[1] - 1, 1))


def normals(points: DataFrame, k: int = 15) -> DataFrame:
    """(shape_id, vid, nx, ny, nz): direction of least spread among the k nearest, pointing away from the centroid."""

    def kernel(q):
        p = xyz(q)
        n = _frames(p, k)[1][:, :, 0]
        n[((p - p.mean(axis=0)) * n).sum(axis=1) < 0] *= -1
        return {"vid": q["vid"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]}

    return per_shape(points, kernel, "vid long, nx double, ny double, nz double")


def local_curvature(points: DataFrame, k: int = 15) -> DataFrame:
    """(shape_id, vid, variation, linearity): least eigenvalue over the sum, and relative gap of the two largest."""

    def kernel(q):
        w = _frames(xyz(q), k)[0]
        return {"vid": q["vid"], "variation": w[:, 0] / np.maximum(w.sum(axis=1), TINY), "linearity": (w[:, 2] - w[:, 1]) / np.maximum(w[:, 2], TINY)}

    return per_shape(points, kernel, "vid long, variation double, linearity double")


def covariance(points: DataFrame) -> DataFrame:
    """(shape_id, n, mx, my, mz, xx, xy, xz, yy, yz, zz): sample covariance by one aggregation with partial sums."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return points.groupBy("shape_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in XYZ), *(F.covar_samp(a, b).alias(a + b) for a, b in pairs))


def pca_axes(points: DataFrame) -> DataFrame:
    """(shape_id, axis, variance, ax, ay, az): principal axes by falling variance; the largest component of each is positive."""

    def kernel(r):
        c = r.iloc[0]
        m = np.array([[c.xx, c.xy, c.xz], [c.xy, c.yy, c.yz], [c.xz, c.yz, c.zz]], float)
        w, v = np.linalg.eigh(np.nan_to_num(m))
        w, v = w[::-1], v[:, ::-1]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(3)])
        return {"axis": np.arange(3), "variance": w, "ax": v[0], "ay": v[1], "az": v[2]}

    return per_shape(covariance(points), kernel, "axis int, variance double, ax double, ay double, az double", order="n")


def align_to_pca(points: DataFrame) -> DataFrame:
    """Points about the centroid in the frame of the principal axes."""
    axes = pca_axes(points).groupBy("shape_id").pivot("axis", [0, 1, 2]).agg(F.first("ax").alias("x"), F.first("ay").alias("y"), F.first("az").alias("z"))
    mid = points.groupBy("shape_id").agg(*(F.avg(c).alias(f"m{c}") for c in XYZ))
    p = points.join(mid.join(axes, "shape_id"), "shape_id")
    along = lambda i: sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"{i}_{c}") for c in XYZ[1:]), (F.col("x") - F.col("mx")) * F.col(f"{i}_x"))
    return p.select("shape_id", "vid", *(along(i).alias(c) for i, c in enumerate(XYZ)))


def procrustes(source: DataFrame, target: DataFrame) -> DataFrame:
    """(shape_id, vid, x, y, z) of ``source`` turned, scaled and moved onto ``target``, rows matched by vid; the rotation keeps orientation."""

    def kernel(a, b):
        both = a.merge(b, on="vid", suffixes=("", "_t"))
        p, q = both[XYZ].to_numpy(float), both[[f"{c}_t" for c in XYZ]].to_numpy(float)
        mp, mq = p.mean(axis=0), q.mean(axis=0)
        u, s, vt = np.linalg.svd((p - mp).T @ (q - mq))
        fix = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
        scale = (s * fix).sum() / max(np.square(p - mp).sum(), TINY)
        out = scale * (p - mp) @ (u * fix @ vt) + mq
        return {"vid": both["vid"], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]}

    return per_pair(source, target, kernel, "vid long, x double, y double, z double", ("vid", "vid"))


def farthest_points(points: DataFrame, n: int) -> DataFrame:
    """(shape_id, rank, vid): greedy farthest-point sample from the smallest vid on; all points if there are no more than n."""

    def kernel(q):
        p, chosen = xyz(q), [0]
        gap = squared(p, p[:1])[:, 0]
        while len(chosen) < min(n, len(p)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(p, p[chosen[-1:]])[:, 0])
        return {"rank": np.arange(len(chosen)), "vid": q["vid"].to_numpy()[chosen]}

    return per_shape(points, kernel, "rank int, vid long")


def nearest_gaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each point to the other cloud, both ways."""
    p, q = xyz(a), xyz(b)
    there, back = np.empty(len(p)), np.full(len(q), np.inf)
    for s in blocks(len(p), len(q)):
        d = squared(p[s], q)
        there[s] = d.min(axis=1)
        back = np.minimum(back, d.min(axis=0))
    return there, back


def cloud_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shape_id, hausdorff, hausdorff_ab, chamfer) between clouds of the same shape_id: largest gap either way, from a to b, and the sum of the mean squared gaps."""

    def kernel(p, q):
        if not len(q):
            return {"hausdorff": [], "hausdorff_ab": [], "chamfer": []}
        there, back = nearest_gaps(p, q)
        return {"hausdorff": [np.sqrt(max(there.max(), back.max()))], "hausdorff_ab": [np.sqrt(there.max())], "chamfer": [there.mean() + back.mean()]}

    return per_pair(a, b, kernel, "hausdorff double, hausdorff_ab double, chamfer double", ("vid", "vid"))


def knn_laplacian(points: DataFrame, k: int = 30, kind: str = "gaussian") -> DataFrame:
    """Entries (shape_id, i, j, w, mass) of a cloud's Laplacian; mass is set on the diagonal.

    gaussian: exp(-d^2 / 2 s^2) with s the median neighbour distance, made
    symmetric by the mean of both directions, mass = degree.  belkin_niyogi:
    heat kernel exp(-d^2 / 4 e) / (4 pi e) with e the squared mean distance,
    divided by the number of points, mass 1/n.
    """

    def kernel(q):
        p, ids = xyz(q), q["vid"].to_numpy()
        at, far = nearest(p, k)
        n = len(p)
        other = far[:, 1:]
        if kind == "gaussian":
            s = max(np.median(other), 1e-12) if other.size else 1.0
            w = np.exp(-np.square(far) / (2 * s * s))
        else:
            e = max(other.mean() ** 2, 1e-12) if other.size else 1.0
            w = np.exp(-np.square(far) / (4 * e)) / (4 * np.pi * e)
        i, j, w = np.repeat(np.arange(n), at.shape[1]), at.ravel(), w.ravel() / 2
        key = np.concatenate([i * n + j, j * n + i, np.arange(n) * (n + 1)])  # a point with k copies before it isn't its own neighbour, its diagonal has a degree all the same
        cell, inverse = np.unique(key, return_inverse=True)
        weight = np.bincount(inverse, np.concatenate([w, w, np.zeros(n)]), len(cell))
        i, j = cell // n, cell % n
        degree = np.bincount(i, weight, n)
        out = np.where(i == j, degree[i] - weight, -weight) / (1 if kind == "gaussian" else n)
        mass = np.where(i == j, degree[i] if kind == "gaussian" else 1 / n, 0.0)
        return {"i": ids[i], "j": ids[j], "w": out, "mass": mass}

    return per_shape(points, kernel, "i long, j long, w double, mass double")
