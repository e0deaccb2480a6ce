"""Distances between sets of descriptors (shape_id, parcel, vid, f array) and matrices made of them."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import inference
from .kernels import blocks, per_shape, squared
from .order import midranks

MEANS = ("euclidean", "cosine", "correlation")


def _wasserstein(x: np.ndarray, y: np.ndarray) -> float:
    """The integral of |F_x - F_y| of two sorted samples."""
    both = np.sort(np.concatenate([x, y]))
    gap = np.diff(both)
    return float((np.abs(np.searchsorted(x, both[:-1], "right") / len(x) - np.searchsorted(y, both[:-1], "right") / len(y)) * gap).sum())


def _gaussian_mean(x: np.ndarray, y: np.ndarray, sigma: float) -> float:
    """Mean of the Gaussian kernel over all pairs; distances by products of matrices, about a common centre so that little cancels."""
    centre = (x.mean(axis=0) + y.mean(axis=0)) / 2
    x, y = x - centre, y - centre
    a, b, total = np.square(x).sum(axis=1), np.square(y).sum(axis=1), 0.0
    for s in blocks(len(x), len(y), 1 << 20):
        far = x[s] @ y.T
        far *= -2
        far += a[s][:, None]
        far += b
        np.maximum(far, 0, out=far)
        far /= -2 * sigma * sigma
        total += float(np.exp(far, out=far).sum())
    return total / (len(x) * len(y))


def mmd(x: np.ndarray, y: np.ndarray, sigma: float | None = None) -> float:
    """Root of the biased squared discrepancy under a Gaussian kernel, kept at 0 or more; sigma defaults to the median distance of the first 500 rows."""
    if sigma is None:
        some = np.concatenate([x, y])[:500]
        far = np.sqrt(squared(some, some))[np.triu_indices(len(some), 1)]
        sigma = float(np.median(far)) if len(far) and np.median(far) > 0 else 1.0
    return float(np.sqrt(max(_gaussian_mean(x, x, sigma) + _gaussian_mean(y, y, sigma) - 2 * _gaussian_mean(x, y, sigma), 0.0)))


def connectome(descriptors: DataFrame, method: str = "wasserstein", sigma: float | None = None) -> DataFrame:
    """(shape_id, a, b, d) for all pairs a < b of a shape's parcels.

    wasserstein averages the one-dimensional distances over the descriptor's
    entries, mmd takes whole vectors; euclidean, cosine and correlation
    compare the parcels' means.  A shape and entry is one task for
    wasserstein, a shape for mmd.  Null descriptors are left out.
    """
    rows = descriptors.where(F.col("f").isNotNull())
    if method in MEANS:
        at = rows.select("shape_id", "parcel", F.posexplode("f").alias("k", "x")).groupBy("shape_id", "parcel", "k").agg(F.avg("x").alias("x"))
        means = at.groupBy("shape_id", "parcel").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("f"))
        return per_shape(means, _mean_pairs(method), "a long, b long, d double", "parcel")
    if method == "wasserstein":
        entry = rows.select("shape_id", "parcel", F.posexplode("f").alias("k", "x")).where(F.col("x").isNotNull())
        kind = rows.schema["shape_id"].dataType.simpleString()

        def pairs_of(r):
            own = [(p, np.sort(x.to_numpy(float))) for p, x in r.groupby("parcel")["x"]]
            pairs = list(itertools.combinations(own, 2))
            return pd.DataFrame({"shape_id": r["shape_id"].iloc[0], "a": [p[0] for p, _ in pairs], "b": [q[0] for _, q in pairs], "d": [_wasserstein(p[1], q[1]) for p, q in pairs]})

        out = entry.groupBy("shape_id", "k").applyInPandas(pairs_of, f"shape_id {kind}, a long, b long, d double")
        return out.groupBy("shape_id", "a", "b").agg(F.avg("d").alias("d"))
    if method != "mmd":
        raise ValueError(f"unknown method {method}")

    def whole(r):
        own = [(p, np.stack(x.to_numpy()).astype(float)) for p, x in r.groupby("parcel")["f"]]
        pairs = list(itertools.combinations(range(len(own)), 2))
        if sigma is None:
            d = [mmd(own[i][1], own[j][1]) for i, j in pairs]
        else:
            alone = [_gaussian_mean(x, x, sigma) for _, x in own]  # once a parcel, not once a pair
            d = [float(np.sqrt(max(alone[i] + alone[j] - 2 * _gaussian_mean(own[i][1], own[j][1], sigma), 0.0))) for i, j in pairs]
        return {"a": [own[i][0] for i, _ in pairs], "b": [own[j][0] for _, j in pairs], "d": d}

    return per_shape(rows.select("shape_id", "parcel", "vid", "f"), whole, "a long, b long, d double", "vid")


def _mean_pairs(method: str):
    def kernel(r):
        x, ids = np.stack(r["f"].to_numpy()).astype(float), r["parcel"].to_numpy()
        i, j = np.triu_indices(len(x), 1)
        if method == "euclidean":
            d = np.linalg.norm(x[i] - x[j], axis=1)
        else:
            y = x - x.mean(axis=1, keepdims=True) if method == "correlation" else x
            n = np.linalg.norm(y, axis=1)
            d = 1 - (y[i] * y[j]).sum(axis=1) / np.maximum(n[i] * n[j], inference.TINY)
        return {"a": ids[i], "b": ids[j], "d": d}

    return kernel


def correlations(rows: DataFrame, names: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, n) for all pairs of named columns, a before b in order of name; rows with a null among the names don't count."""
    names, rows = sorted(names), rows.select(*names).dropna()
    if method == "spearman":
        for n in names:
            rows = midranks(rows, n, f"_{n}").drop(n).withColumnRenamed(f"_{n}", n)
    pairs = list(itertools.combinations(names, 2))
    one = rows.agg(F.count("*").alias("n"), *(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), "n") for i, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def descriptor_distances(descriptors: DataFrame, metric: str = "euclidean", log: bool = True, normalize: str | None = "l1") -> DataFrame:
    """(shape_id, a, b, d) for all pairs a < b of a shape's vertices (shape_id, vid, f), of logs (if wanted) of unit L1 or L2 norm; a shape is one task."""
    if metric not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"unknown metric {metric}")

    def kernel(r):
        x, ids = np.stack(r["f"].to_numpy()).astype(float), r["vid"].to_numpy()
        x = np.log(x + 1e-12) if log else x
        if normalize:
            x = x / (np.linalg.norm(x, ord={"l1": 1, "l2": 2}[normalize], axis=1, keepdims=True) + inference.TINY)
        i, j = np.triu_indices(len(x), 1)
        d = np.empty(len(i))
        for s in blocks(len(i), x.shape[1]):
            p, q = x[i[s]], x[j[s]]
            if metric == "cosine":
                d[s] = 1 - (p * q).sum(axis=1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1), inference.TINY)
            else:
                d[s] = np.abs(p - q).sum(axis=1) if metric == "manhattan" else np.linalg.norm(p - q, axis=1)
        return {"a": ids[i], "b": ids[j], "d": d}

    return per_shape(descriptors, kernel, "a long, b long, d double")


def hybrid_distances(distances: DataFrame, geodesic: DataFrame, alpha: float = 0.7) -> DataFrame:
    """(shape_id, a, b, d): alpha times descriptor distance plus the rest times geodesic distance, each over its median of the positive ones of the shape."""
    from .order import quantiles

    def over_median(df: DataFrame, out: str) -> DataFrame:
        half = quantiles(df.where("d > 0"), "d", {"m": 0.5}, "shape_id")
        return df.join(half, "shape_id").select("shape_id", "a", "b", (F.col("d") / F.greatest("m", F.lit(inference.TINY))).alias(out))

    both = over_median(distances, "x").join(over_median(geodesic, "y"), ["shape_id", "a", "b"])
    return both.select("shape_id", "a", "b", (alpha * F.col("x") + (1 - alpha) * F.col("y")).alias("d"))


def affinity_graph(descriptors: DataFrame, edges: DataFrame, sigma: float | None = None, log: bool = True) -> DataFrame:
    """(shape_id, u, v, w): exp(-d^2 / 2 sigma^2) along a mesh's edges, d the distance of the ends' (logarithmic) descriptors; sigma defaults to the shape's median positive d."""
    from .order import quantiles

    f = F.transform("f", lambda x: F.log(x + 1e-12)) if log else F.col("f")
    at = lambda end: descriptors.select("shape_id", F.col("vid").alias(end), f.alias(f"f_{end}"))
    d = F.sqrt(F.aggregate(F.zip_with("f_u", "f_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = edges.select("shape_id", "u", "v").join(at("u"), ["shape_id", "u"]).join(at("v"), ["shape_id", "v"]).select("shape_id", "u", "v", d.alias("d"))
    rows = rows.withColumn("s", F.lit(float(sigma))) if sigma else rows.join(quantiles(rows.where("d > 0"), "d", {"s": 0.5}, "shape_id"), "shape_id", "left")
    return rows.select("shape_id", "u", "v", F.exp(-F.col("d") * F.col("d") / (2 * F.col("s") * F.col("s"))).alias("w")).fillna(1.0, ["w"])


def multi_kernel(hks: DataFrame, wks: DataFrame, kernels: int = 5, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """(shape_id, a, b, w) for all pairs a <= b of vertices: the mean of Gaussian kernels of both descriptors (shape_id, vid, f) over log-spaced widths; a shape is one task."""
    widths = np.geomspace(low, high, kernels)
    rows = hks.select("shape_id", "vid", "f").join(wks.select("shape_id", "vid", F.col("f").alias("g")), ["shape_id", "vid"])

    def kernel(r):
        ids, total = r["vid"].to_numpy(), 0.0
        for c in ("f", "g"):
            x = np.stack(r[c].to_numpy()).astype(float)
            d = squared(x, x)
            total = total + sum(np.exp(-d / (2 * s * s)) for s in widths)
        i, j = np.triu_indices(len(ids))
        return {"a": ids[i], "b": ids[j], "w": (total / (2 * kernels))[i, j]}

    return per_shape(rows, kernel, "a long, b long, w double")


def moving_average(rows: DataFrame, value: str, order: str, width: int, *by: str) -> DataFrame:
    """Rows with ``smooth``: the mean of the values within width // 2 places before and after, in order within each key ``by``; nulls don't count."""
    near = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return rows.withColumn("smooth", F.avg(value).over(near))


def extremes(rows: DataFrame, z: str = "z", threshold: float = 2.0, *by: str) -> DataFrame:
    """(by..., high, low, share, max_z, min_z, mean_abs): how many scores lie beyond the threshold on each side, their share in percent, and the extremes."""
    x = F.col(z)
    return rows.groupBy(*by).agg(F.count_if(x > threshold).alias("high"), F.count_if(x < -threshold).alias("low"), (100.0 * F.count_if(F.abs(x) > threshold) / F.count(x)).alias("share"), F.max(x).alias("max_z"), F.min(x).alias("min_z"), F.avg(F.abs(x)).alias("mean_abs"))


def classical_scaling(distances: DataFrame, components: int = 2, steps: int = 300, tol: float = 1e-6) -> DataFrame:
    """(shape_id, vid, x array): coordinates whose distances come near the given ones (shape_id, a, b, d, for all pairs a < b).

    They start from the doubly centred matrix's eigenvectors, the largest
    entry of each positive, and are moved by majorisation until the stress
    falls by less than ``tol``; a shape is one task.
    """

    def kernel(r):
        ids = np.unique(np.concatenate([r["a"], r["b"]]))
        i, j, n = np.searchsorted(ids, r["a"]), np.searchsorted(ids, r["b"]), len(ids)
        d = np.zeros((n, n))
        d[i, j] = d[j, i] = r["d"]
        centre = np.eye(n) - 1 / n
        values, vectors = np.linalg.eigh(-centre @ (d * d) @ centre / 2)
        top = np.argsort(-values)[:components]
        vectors = vectors[:, top] * np.where(np.take_along_axis(vectors[:, top], np.abs(vectors[:, top]).argmax(axis=0)[None, :], 0) < 0, -1, 1)
        x, last = vectors * np.sqrt(np.maximum(values[top], 0)), np.inf
        for _ in range(steps):
            far = np.sqrt(squared(x, x))
            stress = float(np.square(far - d).sum() / 2)
            if np.isfinite(last) and last - stress <= tol * max(stress, 1e-300):
                break
            last = stress
            ratio = np.where(far > 0, d / np.maximum(far, 1e-300), 0.0)
            x = (np.diag(ratio.sum(axis=1)) - ratio) @ x / n
        return {"vid": ids, "x": list(x)}

    return per_shape(distances, kernel, "vid long, x array<double>", "a")
