"""Fields of descriptors as signals over a mesh's graph and over scales; a shape is one task.

Descriptors are (shape_id, vid, f array), edges (shape_id, u, v).  The graph's
Laplacian is the degree less the adjacency.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import _kmeans, _nonnegative_start
from .density import hdbscan_labels
from .kernels import nearest, per_pair, per_shape


def _field(r) -> np.ndarray:
    return np.stack(r["f"].to_numpy()).astype(float)


def _graph(r, e) -> np.ndarray:
    """The dense Laplacian of a shape."""
    ids, n = r["vid"].to_numpy(), len(r)
    u, v = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
    a = np.zeros((n, n))
    a[u, v] = a[v, u] = 1
    return np.diag(a.sum(axis=1)) - a


def _pairs(descriptors: DataFrame, edges: DataFrame, kernel, columns: str) -> DataFrame:
    return per_pair(descriptors.select("shape_id", "vid", "f"), edges.select("shape_id", "u", "v"), kernel, columns, ("vid", "u"))


def _cosines(n: int) -> np.ndarray:
    """The orthonormal cosine basis of n places, one frequency a column."""
    t = np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * np.arange(n) / n) * np.sqrt(2 / n)
    t[:, 0] /= np.sqrt(2)
    return t


def denoise_joint(descriptors: DataFrame, edges: DataFrame, alpha: float = 1.0, beta: float = 1.0, modes: int = 50) -> DataFrame:
    """(shape_id, vid, f): fields smoothed at once over the graph and over scales, in the first graph modes and the cosines, each over 1 + alpha x graph + beta x scale frequency."""

    def kernel(r, e):
        h = _field(r)
        lam, u = np.linalg.eigh(_graph(r, e))
        u, lam, c = u[:, :modes], lam[:modes], _cosines(h.shape[1])
        mu = 2 - 2 * np.cos(np.pi * np.arange(h.shape[1]) / h.shape[1])
        smooth = u @ ((u.T @ h @ c) / (1 + alpha * lam[:, None] + beta * mu)) @ c.T
        return {"vid": r["vid"], "f": list(smooth)}

    return _pairs(descriptors, edges, kernel, "vid long, f array<double>")


def _labels(x: np.ndarray, k: int, method: str, seed: int) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.maximum(size, 1e-30)
    return hdbscan_labels(x, max(5, len(x) // (4 * k)), 5) if method == "hdbscan" else _kmeans(x, min(k, len(x)), seed)


def cluster_bands(descriptors: DataFrame, edges: DataFrame, k: int = 6, modes: int = 30, bands: int = 5, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """(shape_id, vid, label) by the energy that a field has at each vertex in bands of graph modes; energies are scaled to length 1."""

    def kernel(r, e):
        h, (_, u) = _field(r), np.linalg.eigh(_graph(r, e))
        parts = np.array_split(np.arange(min(modes, len(h))), bands)
        energy = np.stack([np.square(u[:, p] @ (u[:, p].T @ h)).sum(axis=1) for p in parts if len(p)], axis=1)
        return {"vid": r["vid"], "label": _labels(energy, k, method, seed)}

    return _pairs(descriptors, edges, kernel, "vid long, label int")


def cluster_wavelets(descriptors: DataFrame, edges: DataFrame, k: int = 6, scales: int = 5, kernel_name: str = "mexican_hat", method: str = "kmeans", seed: int = 42) -> DataFrame:
    """(shape_id, vid, label) by the energy of a field's graph wavelet coefficients at log-spaced scales."""
    from .spectral import WAVELETS

    g = WAVELETS[kernel_name]

    def kernel(r, e):
        h, (lam, u) = _field(r), np.linalg.eigh(_graph(r, e))
        top = max(float(lam[-1]), 1e-12)
        energy = [np.square(u @ (g(s * lam)[:, None] * (u.T @ h))).sum(axis=1) for s in np.geomspace(1 / top, 40 / top, scales)]
        return {"vid": r["vid"], "label": _labels(np.stack(energy, axis=1), k, method, seed)}

    return _pairs(descriptors, edges, kernel, "vid long, label int")


def cluster_views(descriptors: DataFrame, edges: DataFrame, k: int = 6, modes: int = 20, neighbours: int = 10, alpha: float = 0.5, fusion: str = "average", seed: int = 42) -> DataFrame:
    """(shape_id, vid, label) from two views, the mesh's graph and the graph of nearest descriptors.

    average takes the modes of alpha times one normalised Laplacian plus the
    rest times the other, concatenate the modes of both side by side.
    """
    if fusion not in ("average", "concatenate"):
        raise ValueError(f"unknown fusion {fusion}")

    def normal(lap: np.ndarray) -> np.ndarray:
        d = 1 / np.sqrt(np.maximum(np.diag(lap), 1e-12))
        return d[:, None] * lap * d

    def kernel(r, e):
        x = _field(r)
        near = nearest(x, neighbours)[0]
        a = np.zeros((len(x), len(x)))
        a[np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()] = 1
        a = np.maximum(a, a.T)
        np.fill_diagonal(a, 0)
        views = normal(_graph(r, e)), normal(np.diag(a.sum(axis=1)) - a)
        if fusion == "average":
            u = np.linalg.eigh(alpha * views[0] + (1 - alpha) * views[1])[1][:, 1 : modes + 1]
        else:
            u = np.concatenate([np.linalg.eigh(v)[1][:, 1 : modes + 1] for v in views], axis=1)
        return {"vid": r["vid"], "label": _labels(u, k, "kmeans", seed)}

    return _pairs(descriptors, edges, kernel, "vid long, label int")


def joint_factors(hks: DataFrame, wks: DataFrame, components: int = 16, steps: int = 200, tol: float = 1e-5, seed: int = 42) -> DataFrame:
    """(shape_id, vid, f): nonnegative weights that two nonnegative descriptors share, each entry scaled by its largest value, by the divergence of Kullback and Leibler."""
    rows = hks.select("shape_id", "vid", "f").join(wks.select("shape_id", "vid", F.col("f").alias("g")), ["shape_id", "vid"])

    def kernel(r):
        x = np.concatenate([_field(r), np.stack(r["g"].to_numpy()).astype(float)], axis=1)
        x = np.maximum(x, 0) / np.maximum(x.max(axis=0), 1e-300)
        w, f = _nonnegative_start(x, components, seed)
        w, f, last = w + 1e-6, f + 1e-6, np.inf
        for _ in range(steps):
            w *= (x / np.maximum(w @ f, 1e-300)) @ f.T / np.maximum(f.sum(axis=1), 1e-300)
            f *= w.T @ (x / np.maximum(w @ f, 1e-300)) / np.maximum(w.sum(axis=0)[:, None], 1e-300)
            y = w @ f
            cost = float((x * np.log(np.maximum(x, 1e-300) / np.maximum(y, 1e-300)) - x + y).sum())
            if last - cost <= tol * abs(last) and np.isfinite(last):
                break
            last = cost
        return {"vid": r["vid"], "f": list(w)}

    return per_shape(rows, kernel, "vid long, f array<double>")


def tensor_factors(tensor: DataFrame, components: int = 8, steps: int = 200, tol: float = 1e-6, seed: int = 42) -> DataFrame:
    """(shape_id, mode, at, component, value): nonnegative factors of a tensor, rows (shape_id, subject, vid, f array).

    Modes are subject, vertex and scale, at is the subject, the vid or the
    place in f; missing rows are 0.  Each component's factor is solved in
    closed form given the others; those of subjects and vertices have length
    1.  A tensor is one task.
    """

    def kernel(r):
        subjects, vids = np.unique(r["subject"]), np.unique(r["vid"])
        x = np.zeros((len(subjects), len(vids), len(r["f"].iloc[0])))
        x[np.searchsorted(subjects, r["subject"]), np.searchsorted(vids, r["vid"])] = np.maximum(_field(r), 0)
        draw = np.random.default_rng(seed)
        a = [draw.random((n, components)) for n in x.shape]
        last = np.inf
        for _ in range(steps):
            for m, path in enumerate(("ijk,jc,kc->ic", "ijk,ic,kc->jc", "ijk,ic,jc->kc")):
                p, q = (a[o] for o in range(3) if o != m)
                pull, gram = np.einsum(path, x, p, q), (p.T @ p) * (q.T @ q)
                for c in range(components):
                    a[m][:, c] = np.maximum(a[m][:, c] + (pull[:, c] - a[m] @ gram[:, c]) / max(gram[c, c], 1e-300), 0)
                if m < 2:  # the scales' factor has the size
                    size = np.linalg.norm(a[m], axis=0)
                    a[m] /= np.maximum(size, 1e-300)
                    a[2] *= size
            cost = float(np.square(x - np.einsum("ic,jc,kc->ijk", *a)).sum())
            if np.isfinite(last) and last - cost <= tol * max(last, 1e-300):
                break
            last = cost
        names = subjects, vids, np.arange(x.shape[2])
        out = {"mode": [], "at": [], "component": [], "value": []}
        for mode, own, values in zip(("subject", "vertex", "scale"), names, a, strict=True):
            out["mode"] += [mode] * values.size
            out["at"] += np.repeat(own, components).tolist()
            out["component"] += np.tile(np.arange(components), len(own)).tolist()
            out["value"] += values.ravel().tolist()
        return out

    return per_shape(tensor, kernel, "mode string, at long, component int, value double", "subject")


def vines(fields: DataFrame, edges: DataFrame, least: float = 0.1, life: float = 0.3) -> DataFrame:
    """(shape_id, vine, t, vid, birth, death): peaks of a field (shape_id, vid, t, value) followed over its scales.

    At each scale a peak is born at its value and dies where its basin meets a
    higher one's (the highest dies at the least value); those of less than
    ``least`` of the scale's range are left out.  From scale to scale the
    nearest births and deaths are linked first, one to one.  Vines that live
    for less than ``life`` of the scales are left out.
    """

    def peaks(y: np.ndarray, at: np.ndarray, j: np.ndarray) -> list[tuple[int, float, float]]:
        order = np.argsort(-y, kind="stable")
        rank, top, out = np.argsort(order), np.arange(len(y)), []

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for v in order.tolist():
            for w in j[at[v] : at[v + 1]].tolist():
                if rank[w] < rank[v]:
                    a, b = sorted((find(v), find(w)), key=lambda x: rank[x])
                    if a != b:
                        if b != v:
                            out.append((b, float(y[b]), float(y[v])))
                        top[b] = a
        out += [(v, float(y[v]), float(y.min())) for v in np.unique([find(v) for v in range(len(y))]).tolist()]
        return [p for p in out if p[1] - p[2] >= least * max(float(np.ptp(y)), 1e-300)]

    def kernel(r, e):
        ids, times = np.unique(r["vid"]), np.unique(r["t"])
        u, v = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
        i, j = np.concatenate([u, v]), np.concatenate([v, u])
        by = np.argsort(i, kind="stable")
        j, at = j[by], np.searchsorted(i[by], np.arange(len(ids) + 1))
        grid = np.zeros((len(times), len(ids)))
        grid[np.searchsorted(times, r["t"]), np.searchsorted(ids, r["vid"])] = r["value"]
        followed, now = [], {}
        for t, y in zip(times.tolist(), grid, strict=True):
            found = peaks(y, at, j)
            links = sorted((abs(followed[k][-1][2] - b) + abs(followed[k][-1][3] - d), k, n) for k in now for n, (_, b, d) in enumerate(found))
            taken, new = set(), {}
            for _, k, n in links:
                if k not in taken and n not in new:
                    taken.add(k)
                    new[n] = k
            for n, (p, b, d) in enumerate(found):
                if n not in new:
                    new[n] = len(followed)
                    followed.append([])
                followed[new[n]].append((t, int(ids[p]), b, d))
            now = dict.fromkeys(new.values())
        rows = [(k, *x) for k, vine in enumerate(followed) if len(vine) >= life * len(times) for x in vine]
        return {c: [x[n] for x in rows] for n, c in enumerate(("vine", "t", "vid", "birth", "death"))}

    return per_pair(fields.select("shape_id", "vid", "t", "value"), edges.select("shape_id", "u", "v"), kernel, "vine int, t int, vid long, birth double, death double", ("vid", "u"))


def auto_cluster(descriptors: DataFrame, edges: DataFrame, methods: dict, *, k: int = 6) -> DataFrame:
    """(method, shape_id, vid, label) of several methods side by side; ``methods`` maps a name to a function of descriptors and edges, and a few are built in by name: bands, wavelets, views."""
    built_in = {"bands": cluster_bands, "wavelets": cluster_wavelets, "views": cluster_views}
    parts = []
    for name, f in methods.items():
        out = f(descriptors, edges) if callable(f) else built_in[f](descriptors, edges, k)
        parts.append(out.select(F.lit(name).alias("method"), "shape_id", "vid", F.col("label").cast("int").alias("label")))
    return functools.reduce(DataFrame.unionByName, parts)
