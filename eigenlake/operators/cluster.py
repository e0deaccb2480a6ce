"""Clusters of descriptor rows (shape_id, vid, f array), over vertices and their edges (shape_id, u, v).

k-means, Gaussian mixtures and PCA run distributed over all rows; what needs a
graph or all distances of a shape runs in one task a shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .eigen import Sparse, smallest_pairs
from .kernels import blocks, nearest, per_pair, per_shape, squared

TINY = 1e-30


def log_l1(descriptors: DataFrame, normalize: str = "l1") -> DataFrame:
    """Logarithm (of at least 1e-12 more than the value), rows divided by their L1 or L2 norm."""
    f = F.transform("f", lambda x: F.log(x + 1e-12))
    d = descriptors.withColumn("f", f)
    norm = F.aggregate("f", F.lit(0.0), lambda s, x: s + (F.abs(x) if normalize == "l1" else x * x))
    norm = F.sqrt(norm) if normalize == "l2" else norm
    return d if normalize == "none" else d.withColumn("f", F.transform("f", lambda x: x / (norm + TINY)))


def kmeans(descriptors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(shape_id, vid, label): k-means over all rows."""
    x = descriptors.select("shape_id", "vid", array_to_vector("f").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=50).fit(x).transform(x).select("shape_id", "vid", F.col("prediction").alias("label"))


def _posterior(x: np.ndarray, w: np.ndarray, m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components in each row, and its log-likelihood; c holds variances or whole covariances."""
    log = np.empty((len(x), len(w)))
    for i in range(len(w)):
        if c.ndim == 2:
            z, size = (x - m[i]) / np.sqrt(c[i]), np.log(c[i]).sum()
        else:
            low = np.linalg.cholesky(c[i])
            z, size = (x - m[i]) @ np.linalg.inv(low).T, 2 * np.log(np.diag(low)).sum()
        log[:, i] = np.log(w[i]) - 0.5 * ((z * z).sum(axis=1) + size + x.shape[1] * np.log(2 * np.pi))
    top = log.max(axis=1, keepdims=True)
    q = np.exp(log - top)
    return q / q.sum(axis=1, keepdims=True), top[:, 0] + np.log(q.sum(axis=1))


def _em(descriptors: DataFrame, k: int, seed: int, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances, or whole covariances, of a Gaussian mixture over all rows.

    EM from the groups of k-means, until the mean log-likelihood changes by
    less than 1e-3, 200 rounds at most; 1e-6 is added to the variances.  Sums
    of a round are one row a number, whatever the rows.
    """
    rows = descriptors.select("f").persist()
    try:
        m = np.array(KMeans(k=k, seed=seed, maxIter=50).fit(rows.select(array_to_vector("f").alias("features"))).clusterCenters())
        k, d = m.shape
        width = d * d if full else d
        w, c, last = None, None, -np.inf

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + k * (1 + d + width))
            for b in batches:
                if not len(b):
                    continue
                x = _x(b)
                if w is None:  # the groups of k-means
                    q, fits = np.eye(k)[squared(x, m).argmin(axis=1)], np.zeros(1)
                else:
                    q, fits = _posterior(x, w, m, c)
                off = [x - center for center in m]
                second = [((q[:, i, None] * off[i]).T @ off[i]).ravel() if full else q[:, i] @ off[i] ** 2 for i in range(k)]
                total += np.concatenate([[fits.sum()], q.sum(axis=0), *(q[:, i] @ off[i] for i in range(k)), *second])
            yield pd.DataFrame({"at": np.arange(len(total)), "g": total})

        for _ in range(201):
            found = rows.mapInPandas(partial, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
            g = np.array([r.g for r in sorted(found)])
            n, first, second = g[1 : k + 1] + 10 * np.finfo(float).eps, g[k + 1 :][: k * d].reshape(k, d), g[k + 1 + k * d :].reshape(k, -1)
            mean, fitted = g[0] / n.sum(), w is not None
            if fitted and abs(mean - last) < 1e-3:
                break
            last = mean if fitted else last
            step = first / n[:, None]
            second = second / n[:, None]
            if full:
                c = second.reshape(k, d, d) - step[:, :, None] * step[:, None, :]
                c = (c + c.transpose(0, 2, 1)) / 2 + 1e-6 * np.eye(d)
            else:
                c = np.maximum(second - step**2, 0.0) + 1e-6
            w, m = n / n.sum(), m + step
    finally:
        rows.unpersist()
    return w, m, c


def gmm_codebook(descriptors: DataFrame, k: int = 32, seed: int = 42) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """Weights, means and variances of a diagonal Gaussian mixture over all rows, for fisher_vector; its size doesn't depend on the rows."""
    w, m, v = _em(descriptors, k, seed, False)
    return w.tolist(), m.tolist(), v.tolist()


def mixture(descriptors: DataFrame, k: int = 25, seed: int = 42) -> DataFrame:
    """(shape_id, vid, label, probability) by a Gaussian mixture of k components with whole covariances."""
    model = _em(descriptors, k, seed, True)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = _posterior(_x(b), *model)[0]
                yield pd.DataFrame({"shape_id": b["shape_id"], "vid": b["vid"], "label": q.argmax(axis=1), "probability": q.max(axis=1)})

    kinds = {x: descriptors.schema[x].dataType.simpleString() for x in ("shape_id", "vid")}
    return descriptors.select("shape_id", "vid", "f").mapInPandas(label, f"shape_id {kinds['shape_id']}, vid {kinds['vid']}, label int, probability double")


def spectral_pca(descriptors: DataFrame, components: int = 2) -> DataFrame:
    """(shape_id, vid, f): scores on the principal components of the centred columns."""
    x = descriptors.select("shape_id", "vid", array_to_vector("f").alias("raw"))
    x = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(x).transform(x)
    return PCA(k=components, inputCol="centred", outputCol="pc").fit(x).transform(x).select("shape_id", "vid", vector_to_array("pc").alias("f"))


def temporal_fpca(descriptors: DataFrame, components: int = 6, k: int = 6, seed: int = 42) -> DataFrame:
    """(shape_id, vid, label): rows standardised along scales, then PCA and k-means."""
    mean = F.aggregate("f", F.lit(0.0), lambda s, x: s + x) / F.size("f")
    d = descriptors.withColumn("m", mean)
    sd = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / F.size("f"))
    d = d.withColumn("sd", sd).withColumn("f", F.transform("f", lambda x: (x - F.col("m")) / (F.col("sd") + TINY)))
    return kmeans(spectral_pca(d, components), k, seed)


def fuse(hks: DataFrame, wks: DataFrame, weight_hks: float = 1.0, weight_wks: float = 1.0) -> DataFrame:
    """Both descriptors of a vertex in one row: log, L1 per block, weighted."""
    a = log_l1(hks).select("shape_id", "vid", F.transform("f", lambda x: x * weight_hks).alias("a"))
    b = log_l1(wks).select("shape_id", "vid", F.transform("f", lambda x: x * weight_wks).alias("b"))
    return a.join(b, ["shape_id", "vid"]).select("shape_id", "vid", F.concat("a", "b").alias("f"))


def _x(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["f"].to_numpy()).astype(float)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compact(label: np.ndarray) -> np.ndarray:
    """Labels from 0 in order, -1 stays."""
    names = np.unique(label[label >= 0])
    return np.where(label >= 0, np.searchsorted(names, label), -1)


def _dbscan(n: int, near: list[np.ndarray], least: int) -> np.ndarray:
    core = np.array([len(x) >= least for x in near], bool)
    own = np.concatenate([np.full(len(x), i) for i, x in enumerate(near)]) if n else np.empty(0, int)
    other = np.concatenate(near) if n else np.empty(0, int)
    inner = core[own] & core[other]
    root = np.where(core, _roots(n, own[inner], other[inner]), -1)
    edge = core[other] & ~core[own]
    reach = np.full(n, n)
    np.minimum.at(reach, own[edge], root[other[edge]])
    return _compact(np.where(core, root, np.where(reach < n, reach, -1)))


def dbscan(descriptors: DataFrame, eps: float | None = None, least: int = 10) -> DataFrame:
    """(shape_id, vid, label): density clusters within a shape; -1 is noise, a border point goes to its smallest cluster; eps defaults to the 90th percentile of the distance to the least-th neighbour."""

    def kernel(r):
        x = _x(r)
        e = float(np.quantile(nearest(x, least)[1][:, -1], 0.9)) if eps is None else eps
        near = [np.flatnonzero(row) for s in blocks(len(x), len(x)) for row in squared(x[s], x) <= e * e]
        return {"vid": r["vid"], "label": _dbscan(len(x), near, least)}

    return per_shape(descriptors, kernel, "vid long, label int")


def st_dbscan(descriptors: DataFrame, edges: DataFrame, eps_temporal: float | None = None, hops: int = 3, least: int = 10) -> DataFrame:
    """(shape_id, vid, label): neighbours are within ``hops`` edges and eps_temporal in descriptor distance (default twice the median along edges)."""

    def kernel(r, e):
        x, ids, n = _x(r), r["vid"].to_numpy(), len(r)
        u, v = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
        far = np.sqrt(np.square(x[u] - x[v]).sum(axis=1))
        limit = 2 * float(np.median(far)) if eps_temporal is None and len(far) else eps_temporal or 0.0
        i, j = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.argsort(i, kind="stable")
        j, at = j[order], np.searchsorted(i[order], np.arange(n + 1))
        near = []
        for s in range(n):
            ring = seen = np.array([s])
            for _ in range(hops):
                ring = np.setdiff1d(np.concatenate([j[at[y] : at[y + 1]] for y in ring]), seen) if len(ring) else ring
                seen = np.union1d(seen, ring)
            near.append(seen[np.square(x[seen] - x[s]).sum(axis=1) <= limit * limit])
        return {"vid": ids, "label": _dbscan(n, near, least)}

    return per_pair(descriptors, edges, kernel, "vid long, label int", ("vid", "u"))


def _kmeans(x: np.ndarray, k: int, seed: int, steps: int = 100) -> np.ndarray:
    """k-means within a task, from the best of five starts by k-means++."""
    best, found, draw = np.inf, np.zeros(len(x), int), np.random.default_rng(seed)
    k = min(k, len(x))
    for _ in range(5):
        c = x[[draw.integers(len(x))]]
        while len(c) < k:
            gap = squared(x, c).min(axis=1)
            c = np.vstack([c, x[draw.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else draw.integers(len(x))]])
        for _ in range(steps):
            d = squared(x, c)
            label = d.argmin(axis=1)
            new = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        if (cost := d.min(axis=1).sum()) < best:
            best, found = cost, label
    return found


def spectral_clusters(descriptors: DataFrame, k: int, neighbours: int = 20, seed: int = 42) -> DataFrame:
    """(shape_id, vid, label): k-means on the leading eigenvectors of the normalised Laplacian of each shape's neighbour graph."""

    def kernel(r):
        x, n = _x(r), len(r)
        at, far = nearest(x, neighbours)
        s = max(float(np.median(far[:, 1:])), 1e-12) if far.shape[1] > 1 else 1.0
        i, j, w = np.repeat(np.arange(n), at.shape[1]), at.ravel(), np.exp(-np.square(far.ravel()) / (2 * s * s)) / 2
        i, j, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
        degree = np.bincount(i, w, n)
        lap = Sparse(np.concatenate([i, np.arange(n)]), np.concatenate([j, np.arange(n)]), np.concatenate([-w, degree]), n)
        _, phi = smallest_pairs(lap, degree, k, tol=1e-6)
        phi = phi / np.maximum(np.linalg.norm(phi, axis=1, keepdims=True), 1e-12)
        return {"vid": r["vid"], "label": _kmeans(phi, k, seed)}

    return per_shape(descriptors, kernel, "vid long, label int")


def _nonnegative_start(h: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors from the singular vectors: of each pair the signs' half that weighs more; beyond the rank, small seeded numbers."""
    u, s, vt = np.linalg.svd(h, full_matrices=False)
    draw = np.random.default_rng(seed)
    w, f = draw.random((len(h), k)) * 1e-3, draw.random((k, h.shape[1])) * 1e-3
    for c in range(min(k, int((s > 1e-12 * max(s[0], 1e-300)).sum()) if len(s) else 0)):
        halves = [(np.maximum(sign * u[:, c], 0), np.maximum(sign * vt[c], 0)) for sign in (1, -1)]
        left, right = max(halves, key=lambda x: np.linalg.norm(x[0]) * np.linalg.norm(x[1]))
        w[:, c] += left * np.sqrt(s[c])
        f[c] += right * np.sqrt(s[c])
    return w, f


def gnmf(descriptors: DataFrame, edges: DataFrame, components: int = 8, smooth: float = 1.0, smooth_scales: float = 0.0, sparsity: float = 0.0, steps: int = 300, tol: float = 1e-5, seed: int = 42) -> DataFrame:
    """(shape_id, vid, label, weights): nonnegative factors with a graph term over vertices, and a chain term over scales if wanted; the label is the largest weight.

    Components are solved one after the other in closed form, given the
    others and the neighbours' present weights, from the singular vectors on,
    until no weight changes by more than ``tol`` of the largest.
    """

    def kernel(r, e):
        h, ids, n = np.maximum(_x(r), 0), r["vid"].to_numpy(), len(r)
        u, v = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
        near = Sparse(np.concatenate([u, v]), np.concatenate([v, u]), np.ones(2 * len(u)), n)
        pull = smooth * np.bincount(near.i, minlength=n)
        beside = smooth_scales * (np.eye(h.shape[1], k=1) + np.eye(h.shape[1], k=-1))
        w, f = _nonnegative_start(h, components, seed)
        for _ in range(steps):
            before = w.copy()
            for c in range(components):
                rest = h @ f[c] - w @ (f @ f[c]) + w[:, c] * (f[c] @ f[c])
                w[:, c] = np.maximum(rest + smooth * (near @ w[:, c]) - sparsity / 2, 0) / np.maximum(f[c] @ f[c] + pull, 1e-300)
            for c in range(components):
                rest = w[:, c] @ h - (w[:, c] @ w) @ f + (w[:, c] @ w[:, c]) * f[c]
                f[c] = np.maximum(rest + beside @ f[c], 0) / np.maximum(w[:, c] @ w[:, c] + beside.sum(axis=0), 1e-300)
            if np.abs(w - before).max(initial=0) <= tol * np.abs(w).max(initial=0):
                break
        return {"vid": ids, "label": w.argmax(axis=1), "weights": list(w)}

    return per_pair(descriptors, edges, kernel, "vid long, label int, weights array<double>", ("vid", "u"))


def persistence(field: DataFrame, edges: DataFrame, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """(shape_id, vid, label, peak): basins of the peaks of a field (shape_id, vid, value).

    Vertices join by falling value (equal ones by id); where two basins meet,
    the one of the lower peak is merged if its peak is less than ``threshold``
    above the meeting place.  Without a threshold, the largest gap between
    persistences (or the k-th largest one) decides.
    """

    def kernel(r, e):
        ids, y, n = r["vid"].to_numpy(), r["value"].to_numpy(float), len(r)
        u, v = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
        i, j = np.concatenate([u, v]), np.concatenate([v, u])
        by = np.argsort(i, kind="stable")
        j, at = j[by], np.searchsorted(i[by], np.arange(n + 1))
        order = np.argsort(-y, kind="stable")
        rank = np.empty(n, int)
        rank[order] = np.arange(n)

        def grow(tau: float) -> tuple[np.ndarray, list[float]]:
            parent, life = np.arange(n), []

            def top(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x in order:
                near = sorted({top(z) for z in j[at[x] : at[x + 1]] if rank[z] < rank[x]}, key=lambda z: rank[z])
                if not near:
                    continue
                parent[x] = near[0]
                for z in near[1:]:
                    life.append(y[z] - y[x])
                    if y[z] - y[x] < tau:
                        parent[z] = near[0]
            return np.array([top(x) for x in range(n)]), life

        tau = threshold
        if tau is None:
            lives = np.sort(np.array(grow(np.inf)[1]))[::-1]
            if k is not None:
                tau = (lives[k - 2] if k >= 2 and len(lives) >= k - 1 else np.inf) if k > 1 else np.inf
            elif len(lives) > 1:
                gap = int(np.argmax(lives[:-1] - lives[1:]))
                tau = (lives[gap] + lives[gap + 1]) / 2
            else:
                tau = 0.0
        root, _ = grow(tau)
        return {"vid": ids, "label": _compact(root), "peak": ids[root]}

    return per_pair(field.select("shape_id", "vid", "value"), edges.select("shape_id", "u", "v"), kernel, "vid long, label int, peak long", ("vid", "u"))


def quality(labelled: DataFrame) -> DataFrame:
    """(shape_id, clusters, calinski_harabasz, davies_bouldin) of rows (shape_id, vid, f, label); noise is left out; null for fewer than two clusters.

    From sums a cluster only, so that no distances between rows are formed.
    """
    at = labelled.where("label >= 0").select("shape_id", "vid", "label", F.posexplode("f").alias("d", "x"))
    centre = at.groupBy("shape_id", "label", "d").agg(F.avg("x").alias("c"), F.count("*").alias("n"))
    grand = at.groupBy("shape_id", "d").agg(F.avg("x").alias("g"))
    between = centre.join(grand, ["shape_id", "d"]).groupBy("shape_id").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) * (F.col("c") - F.col("g"))).alias("b"))
    row = at.join(centre.drop("n"), ["shape_id", "label", "d"]).groupBy("shape_id", "label", "vid").agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("d2"))
    spread = row.groupBy("shape_id", "label").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.count("*").alias("n"))
    total = spread.groupBy("shape_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    a, b = (centre.select("shape_id", F.col("label").alias(x), "d", F.col("c").alias(f"c{x}")) for x in ("la", "lb"))
    far = a.join(b, ["shape_id", "d"]).where("la <> lb").groupBy("shape_id", "la", "lb").agg(F.sqrt(F.sum((F.col("cla") - F.col("clb")) * (F.col("cla") - F.col("clb")))).alias("m"))
    sa, sb = (spread.select("shape_id", F.col("label").alias(x), F.col("s").alias(f"s{x}")) for x in ("la", "lb"))
    db = far.join(sa, ["shape_id", "la"]).join(sb, ["shape_id", "lb"]).groupBy("shape_id", "la").agg(F.max((F.col("sla") + F.col("slb")) / F.nullif(F.col("m"), F.lit(0.0))).alias("r")).groupBy("shape_id").agg(F.avg("r").alias("davies_bouldin"))
    ch = F.when(F.col("k") > 1, F.col("b") / (F.col("k") - 1) / F.nullif(F.col("w") / (F.col("n") - F.col("k")), F.lit(0.0)))
    return total.join(between, "shape_id").join(db, "shape_id", "left").select("shape_id", F.col("k").alias("clusters"), ch.alias("calinski_harabasz"), "davies_bouldin")


def silhouette(labelled: DataFrame) -> DataFrame:
    """(shape_id, silhouette): mean over rows of label >= 0, distances in blocks inside a shape's task; null for fewer than two clusters, 0 for a row alone in its cluster."""

    def kernel(r):
        x, names = _x(r), np.unique(r["label"])
        if len(names) < 2:
            return {"silhouette": [None]}
        own = np.searchsorted(names, r["label"])
        size, score = np.bincount(own), []
        member = np.eye(len(names))[own]
        for s in blocks(len(x), len(x)):
            mean = np.sqrt(squared(x[s], x)) @ member
            at, mine = np.arange(mean.shape[0]), own[s]
            a = mean[at, mine] / np.maximum(size[mine] - 1, 1)
            other = mean / size
            other[at, mine] = np.inf
            b = other.min(axis=1)
            score.append(np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), TINY), 0.0))
        return {"silhouette": [float(np.concatenate(score).mean())]}

    return per_shape(labelled.where("label >= 0"), kernel, "silhouette double")


def coherence(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """(shape_id, coherence): share of edges whose ends have one label, noise left out."""
    l = labelled.where("label >= 0")
    e = edges.join(l.select("shape_id", F.col("vid").alias("u"), F.col("label").alias("lu")), ["shape_id", "u"]).join(l.select("shape_id", F.col("vid").alias("v"), F.col("label").alias("lv")), ["shape_id", "v"])
    return e.groupBy("shape_id").agg(F.avg((F.col("lu") == F.col("lv")).cast("double")).alias("coherence"))


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari, nmi, homogeneity, completeness, v) of two labellings (shape_id, vid, label) over rows that neither calls noise; from the table of counts."""
    both = a.where("label >= 0").select("shape_id", "vid", F.col("label").alias("la")).join(b.where("label >= 0").select("shape_id", "vid", F.col("label").alias("lb")), ["shape_id", "vid"])
    cells = both.groupBy("la", "lb").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    plogn = lambda c: F.sum(F.col(c) * F.log(c))
    one = cells.agg(pairs("n").alias("pij"), plogn("n").alias("lij"), F.sum("n").alias("t"))
    ra = cells.groupBy("la").agg(F.sum("n").alias("m")).agg(pairs("m").alias("pa"), plogn("m").alias("sa"))
    rb = cells.groupBy("lb").agg(F.sum("n").alias("m")).agg(pairs("m").alias("pb"), plogn("m").alias("sb"))
    t = one.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(rb))  # three single rows
    n, log_n = F.col("t"), F.log("t")
    expect = F.col("pa") * F.col("pb") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2
    ha, hb = log_n - F.col("sa") / n, log_n - F.col("sb") / n
    mi = ha + hb - (log_n - F.col("lij") / n)
    share = lambda h: F.when(h <= 1e-12, 1.0).otherwise(mi / F.nullif(h, F.lit(0.0)))
    v = F.when(ha + hb <= 1e-12, 1.0).otherwise(2 * mi / F.nullif(ha + hb, F.lit(0.0)))
    ari = F.when(F.abs(top - expect) < 1e-12, 1.0).otherwise((F.col("pij") - expect) / F.nullif(top - expect, F.lit(0.0)))
    return t.select(ari.alias("ari"), v.alias("nmi"), share(ha).alias("homogeneity"), share(hb).alias("completeness"), v.alias("v"))


def scalespace_blobs(fields: DataFrame, edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(shape_id, vid, t, value): at each time the vertices whose t^gamma-scaled value is above all their neighbours', of fields (shape_id, vid, t, time, value)."""
    s = fields.withColumn("value", F.pow("time", F.lit(gamma)) * F.col("value")).select("shape_id", "vid", "t", "value")
    both = edges.select("shape_id", F.col("u").alias("vid"), F.col("v").alias("to")).unionByName(edges.select("shape_id", F.col("v").alias("vid"), F.col("u").alias("to"))).distinct()
    near = both.join(s.withColumnsRenamed({"vid": "to", "value": "other"}), ["shape_id", "to"]).groupBy("shape_id", "vid", "t").agg(F.max("other").alias("other"))
    return s.join(near, ["shape_id", "vid", "t"]).where("value > other").drop("other")


def mapper(descriptors: DataFrame, cubes: int = 15, overlap: float = 0.3, eps: float = 0.5, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (shape_id, node, vid) and links (shape_id, a, b, shared) of the nerve: the sum of a row is its lens, overlapping intervals cover it, density clusters within an interval are nodes."""
    lens = descriptors.withColumn("lens", F.aggregate("f", F.lit(0.0), lambda s, x: s + x))
    w = Window.partitionBy("shape_id")
    width = (F.max("lens").over(w) - F.min("lens").over(w)) / cubes
    lens = lens.withColumn("low", F.min("lens").over(w)).withColumn("width", F.greatest(width, F.lit(1e-12)))
    place = (F.col("lens") - F.col("low")) / F.col("width")
    cover = F.filter(F.sequence(F.lit(0), F.lit(cubes - 1)), lambda c: (place >= c - overlap / 2) & (place <= c + 1 + overlap / 2))
    parts = lens.select("shape_id", "vid", "f", F.explode(cover).alias("cube"))

    def kernel(r):
        out = []
        for cube, g in r.groupby("cube", sort=True):
            x = _x(g)
            near = [np.flatnonzero(row) for s in blocks(len(x), len(x)) for row in squared(x[s], x) <= eps * eps]
            label = _dbscan(len(x), near, least)
            out.append(pd.DataFrame({"node": [f"{cube}-{i}" for i in label], "vid": g["vid"].to_numpy()})[label >= 0])
        return pd.concat(out) if out else {"node": [], "vid": []}

    nodes = per_shape(parts, kernel, "node string, vid long")
    a, b = nodes.withColumnRenamed("node", "a"), nodes.withColumnRenamed("node", "b")
    return nodes, a.join(b, ["shape_id", "vid"]).where("a < b").groupBy("shape_id", "a", "b").agg(F.count("*").alias("shared"))
