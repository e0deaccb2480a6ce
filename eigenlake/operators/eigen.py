"""Eigenpairs of Laplacians, geodesics and what is built on them; a shape is one task.

Entries (shape_id, i, j, w) come from ``geometry.cotangent_laplacian`` or
``cloud.knn_laplacian``, masses (shape_id, vid, area) from ``vertex_areas``.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry, spectral
from .kernels import blocks, nearest, per_pair, per_shape, xyz

#: Vertices up to which the matrix is solved dense.
DENSE = 1500

#: Vertices up to which the coarsest matrix of a multigrid is inverted dense.
COARSE = 400


class Sparse:
    """Symmetric matrix in rows: products with dense blocks by one gather and one segmented sum."""

    def __init__(self, i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int):
        order = np.lexsort((j, i))
        self.i, self.j, self.w, self.n = i[order], j[order], w[order], n
        self.rows = np.flatnonzero(np.append(True, self.i[1:] != self.i[:-1])) if len(self.i) else np.empty(0, np.int64)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, *x.shape[1:]))
        if len(self.i) and x.ndim == 1:
            out[self.i[self.rows]] = np.add.reduceat(self.w * x[self.j], self.rows)
        elif len(self.i):
            for s in blocks(x.shape[1], len(self.i)):
                out[self.i[self.rows], s] = np.add.reduceat(self.w[:, None] * x[self.j, s], self.rows, axis=0)
        return out

    def diagonal(self) -> np.ndarray:
        on = self.i == self.j
        return np.bincount(self.i[on], self.w[on], self.n)

    def merged(self, to: np.ndarray) -> Sparse:
        """Sums over the groups of vertices 0, 1, ... of ``to``."""
        m = int(to.max()) + 1
        key, at = np.unique(to[self.i] * m + to[self.j], return_inverse=True)
        return Sparse(key // m, key % m, np.bincount(at, self.w, len(key)), m)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (self.i, self.j), self.w)
        return out


def _pairs(a: Sparse, diagonal: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Groups of mostly two vertices, by rounds in which those that are each other's strongest free neighbour join; the rest joins its strongest neighbour.

    A coupling's strength is its share in the smaller of both diagonals; those
    below ``least``, or far below what both vertices have elsewhere, join
    nothing, so a group varies slowly only as a whole.
    """
    every, diagonal = np.arange(a.n), np.maximum(diagonal, 1e-300)
    off = (a.i != a.j) & (a.w < 0)
    i, j, tie = a.i[off], a.j[off], np.random.default_rng(0).random(a.n)
    strength = -a.w[off] / np.minimum(diagonal[i], diagonal[j]) * (1 + 1e-3 * ((tie[i] + tie[j]) % 1))
    order = np.argsort(strength, kind="stable")
    order = order[strength[order] >= least]
    i, j, strength = i[order], j[order], strength[order]
    best, most = every.copy(), np.zeros(a.n)
    best[i], most[i] = j, strength  # of repeated positions the last one, the strongest, stays
    strong = strength >= 0.25 * np.minimum(most[i], most[j])
    i, j, lead, free = i[strong], j[strong], every.copy(), np.ones(a.n, bool)
    for _ in range(10):
        pick = every.copy()
        pick[i] = j
        both = np.flatnonzero((pick != every) & (pick[pick] == every))
        lead[both], free[both] = np.minimum(both, pick[both]), False
        left = free[i] & free[j]
        i, j = i[left], j[left]
    alone = np.flatnonzero(free & ~free[best])
    lead[alone] = lead[best[alone]]
    return np.unique(lead, return_inverse=True)[1]


class _Grid:
    """Approximate inverse of a positive matrix: a multigrid cycle over groups of vertices, with damped Jacobi steps; symmetric, memory a multiple of the entries."""

    def __init__(self, a: Sparse):
        self.a, self.below, self.inverse = a, None, None
        self.scale = np.maximum(np.bincount(a.i, np.abs(a.w), a.n), 1e-300)[:, None]
        if a.n <= COARSE:
            m = a.dense()
            self.inverse = np.linalg.pinv((m + m.T) / 2, rcond=1e-15, hermitian=True)
            return
        diagonal = a.diagonal()
        one = _pairs(a, diagonal)
        middle = a.merged(one)
        two = _pairs(middle, np.bincount(one, diagonal), 0.05)  # this level's own steps must smooth within a group
        self.to, n = two[one], int(two.max()) + 1
        if n < 0.9 * a.n:
            self.order = np.argsort(self.to, kind="stable")
            self.first = np.searchsorted(self.to[self.order], np.arange(n))
            self.below = _Grid(middle.merged(two))

    def __call__(self, r: np.ndarray) -> np.ndarray:
        if self.inverse is not None:
            return self.inverse @ r
        x = r / self.scale
        x += (r - self.a @ x) / self.scale
        if self.below is not None:
            c = np.add.reduceat((r - self.a @ x)[self.order], self.first, axis=0)
            y = self.below(c)
            if self.below.inverse is None and self.below.a.n < self.a.n / 2:
                y = y + self.below(c - self.below.a @ y)
            x += y[self.to]
        for _ in range(2):
            x += (r - self.a @ x) / self.scale
        return x


def smallest_pairs(a: Sparse, mass: np.ndarray, k: int, tol: float = 1e-8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k smallest pairs of A x = lambda M x, eigenvectors of unit mass norm; signs: the largest entry is positive.

    Dense up to ``DENSE`` vertices.  Beyond it a block of about 1.5 k vectors
    is improved along its residuals, divided by the matrix by multigrid, and
    the last steps (LOBPCG), until no residual is over ``tol`` and the values
    no longer fall; copies and far points, whose values crowd near 0, don't
    slow it.  Memory is the nonzero entries and some such blocks; it raises if
    200 rounds don't reach ``tol``.
    """
    root = np.sqrt(np.maximum(mass, 1e-20))
    b = Sparse(a.i, a.j, a.w / (root[a.i] * root[a.j]), a.n)
    k = min(k, a.n)
    if a.n <= DENSE:
        m = b.dense()
        lam, x = np.linalg.eigh((m + m.T) / 2)
    else:
        size, every = min(a.n, k + max(10, k // 2)), np.arange(a.n)
        top = float(np.bincount(b.i, np.abs(b.w), b.n).max())
        near = _Grid(Sparse(np.append(a.i, every), np.append(a.j, every), np.append(a.w, 1e-10 * top * np.square(root)), a.n))
        x = np.linalg.qr(np.random.default_rng(seed).standard_normal((a.n, size)))[0]
        bx = b @ x
        lam, u = np.linalg.eigh(x.T @ bx)
        x, bx, step, last = x @ u, bx @ u, np.empty((a.n, 0)), np.inf
        for _ in range(200):
            rest = bx - x * lam
            wrong = np.linalg.norm(rest[:, :k], axis=0).max()
            if wrong < tol * max(1.0, float(lam[k - 1])) and (last - lam[:k] <= 1e-4 * np.abs(lam[:k]) + 1e-14 * top).all():
                break
            last = lam[:k]
            s = np.hstack([root[:, None] * near(root[:, None] * rest), step])
            for _ in range(2):  # orthonormal, and to x too, without directions that are there already
                s -= x @ (x.T @ s)
                s /= np.maximum(np.linalg.norm(s, axis=0), 1e-300)
                d, v = np.linalg.eigh(s.T @ s)
                s = s @ (v[:, d > 1e-12] / np.sqrt(d[d > 1e-12]))
            q, bq = np.hstack([x, s]), np.hstack([bx, b @ s])
            h = q.T @ bq
            lam, u = np.linalg.eigh((h + h.T) / 2)
            lam, u = lam[:size], u[:, :size]
            x, bx, step = q @ u, bq @ u, s @ u[size:]
        if not wrong < tol * max(1.0, float(lam[k - 1])):
            raise ArithmeticError(f"eigenpairs of {a.n} vertices aren't within {tol} after 200 rounds: {wrong}")
    lam, x = lam[:k], x[:, :k]
    phi = x / root[:, None]
    phi = phi * np.where(phi[np.abs(phi).argmax(axis=0), np.arange(phi.shape[1])] < 0, -1, 1)
    return np.maximum(lam, 0.0), phi


def _matrix(entries: pd.DataFrame, ids: np.ndarray) -> Sparse:
    return Sparse(np.searchsorted(ids, entries["i"].to_numpy()), np.searchsorted(ids, entries["j"].to_numpy()), entries["w"].to_numpy(float), len(ids))


def decompose(entries: DataFrame, mass: DataFrame, k: int = 100) -> DataFrame:
    """(shape_id, vid, lam array, phi array): the k smallest eigenpairs, as the descriptor operators take them; fewer if a shape has fewer vertices."""

    def kernel(m, e):
        lam, phi = smallest_pairs(_matrix(e, m["vid"].to_numpy()), m["area"].to_numpy(float), k)
        return {"vid": m["vid"], "lam": [lam.tolist()] * len(m), "phi": list(phi)}

    return per_pair(mass.select("shape_id", "vid", "area"), entries.select("shape_id", "i", "j", "w"), kernel, "vid long, lam array<double>, phi array<double>", ("vid", "i"))


def decompose_cloud(laplacian: DataFrame, k: int = 50) -> DataFrame:
    """The same for a cloud's Laplacian with masses on its diagonal."""

    def kernel(e):
        own = e[e["i"] == e["j"]]
        lam, phi = smallest_pairs(_matrix(e, own["i"].to_numpy()), own["mass"].to_numpy(float), k)
        return {"vid": own["i"].to_numpy(), "lam": [lam.tolist()] * len(own), "phi": list(phi)}

    return per_shape(laplacian, kernel, "vid long, lam array<double>, phi array<double>", order="i")


def spectral_qc(eig: DataFrame, mass: DataFrame, tolerance: float = 1e-3, zero: float = 1e-4, same: float = 1e-6) -> DataFrame:
    """(shape_id, lambda_0, negative, near_degenerate, orthonormality, passed): checks of eigenpairs; the first 20 vectors are held against unit mass norm."""
    joined = eig.join(mass.select("shape_id", "vid", "area"), ["shape_id", "vid"])

    def kernel(r):
        lam = np.array(r["lam"].iloc[0])
        phi = np.stack(r["phi"].to_numpy())[:, :20]
        wrong = np.abs(phi.T @ (phi * r["area"].to_numpy()[:, None]) - np.eye(phi.shape[1])).max()
        near = int((np.diff(lam) < same).sum())
        return {"lambda_0": [lam[0]], "negative": [int((lam < -1e-8).sum())], "near_degenerate": [near], "orthonormality": [wrong], "passed": [bool(abs(lam[0]) < zero and wrong < tolerance and not (lam < -1e-8).any())]}

    return per_shape(joined, kernel, "lambda_0 double, negative int, near_degenerate int, orthonormality double, passed boolean")


def _is_source(vid: Column, sources: list[int] | Callable[[Column], Column]) -> Column:
    return sources(vid) if callable(sources) else vid.isin(sources)


def geodesic_dijkstra(edges: DataFrame, sources: list[int] | Callable[[Column], Column]) -> DataFrame:
    """(shape_id, vid, distance): shortest way along edges (shape_id, u, v, length) from the nearest source of the shape; infinite where there is none.

    ``sources`` are ids, or a condition on the id.
    """

    def kernel(e):
        ids = np.unique(np.concatenate([e["u"], e["v"]]))
        a, b = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"])
        i, j, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([e["length"], e["length"]])
        order = np.argsort(i, kind="stable")
        j, w, at = j[order], w[order], np.searchsorted(i[order], np.arange(len(ids) + 1))
        far = np.full(len(ids), np.inf)
        heap = [(0.0, int(s)) for s in np.unique(np.concatenate([a[e["u_source"]], b[e["v_source"]]]))]
        for _, s in heap:
            far[s] = 0.0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for y, c in zip(j[at[x] : at[x + 1]].tolist(), w[at[x] : at[x + 1]].tolist(), strict=True):
                if d + c < far[y]:
                    far[y] = d + c
                    heapq.heappush(heap, (d + c, y))
        return {"vid": ids, "distance": far}

    marked = edges.withColumns({f"{c}_source": _is_source(F.col(c), sources) for c in "uv"})
    return per_shape(marked, kernel, "vid long, distance double", order="u")


def conjugate_gradient(product, b: np.ndarray, diagonal: np.ndarray, tol: float = 1e-10, steps: int = 5000) -> np.ndarray:
    """Solves product(x) = b for a positive (semi)definite product, preconditioned by its diagonal."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz, end = z.copy(), float(r @ z), tol * max(float(np.linalg.norm(b)), 1e-300)
    for _ in range(steps):
        if np.linalg.norm(r) <= end:
            break
        q = product(p)
        alpha = rz / float(p @ q)
        x += alpha * p
        r -= alpha * q
        z = r / diagonal
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    return x


def _cotangent(v: np.ndarray, f: np.ndarray) -> tuple[Sparse, np.ndarray]:
    i, j, w, mass = [], [], [], np.zeros(len(v))
    area = np.linalg.norm(np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]), axis=1) / 2
    for c in range(3):
        o, p, q = f[:, c], f[:, (c + 1) % 3], f[:, (c + 2) % 3]
        cot = ((v[p] - v[o]) * (v[q] - v[o])).sum(axis=1) / np.maximum(2 * area, 1e-20) / 2
        i += [p, q, p, q]
        j += [q, p, p, q]
        w += [-cot, -cot, cot, cot]
        mass += np.bincount(o, area / 3, len(v))
    return Sparse(np.concatenate(i), np.concatenate(j), np.concatenate(w), len(v)), np.maximum(mass, 1e-20)


def geodesic_heat(vertices: DataFrame, faces: DataFrame, sources: list[int] | Callable[[Column], Column], t_factor: float = 1.0) -> DataFrame:
    """(shape_id, vid, distance) by the heat method: diffuse for the squared mean edge length, normalise the gradient, solve for its potential; 0 at the nearest point."""

    def kernel(p, q):
        v, ids = xyz(p), p["vid"].to_numpy()
        f = np.searchsorted(ids, q[["i0", "i1", "i2"]].to_numpy())
        lap, mass = _cotangent(v, f)
        side = np.linalg.norm(v[f] - v[np.roll(f, -1, axis=1)], axis=2)
        t = t_factor * side.mean() ** 2
        start = p["source"].to_numpy().astype(float)
        diag = np.bincount(lap.i[lap.i == lap.j], lap.w[lap.i == lap.j], lap.n)
        u = conjugate_gradient(lambda x: mass * x + t * (lap @ x), start, mass + t * diag)
        normal = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
        dbl = np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-20)
        grad = sum(u[f[:, c], None] * np.cross(normal / dbl, v[f[:, (c + 2) % 3]] - v[f[:, (c + 1) % 3]]) for c in range(3)) / dbl
        x = -grad / np.maximum(np.linalg.norm(grad, axis=1, keepdims=True), 1e-300)
        div = np.zeros(len(v))
        for c in range(3):
            o, a, b = f[:, c], f[:, (c + 1) % 3], f[:, (c + 2) % 3]
            cot = lambda s, m, n: ((v[m] - v[s]) * (v[n] - v[s])).sum(axis=1) / dbl[:, 0]
            part = (cot(b, o, a) * ((v[a] - v[o]) * x).sum(axis=1) + cot(a, b, o) * ((v[b] - v[o]) * x).sum(axis=1)) / 2
            div += np.bincount(o, part, len(v))
        phi = conjugate_gradient(lambda y: lap @ y, -(div - div.mean()), np.maximum(diag, 1e-12))
        return {"vid": ids, "distance": phi - phi[start > 0].min() if start.any() else np.full(len(v), np.inf)}

    return per_pair(vertices.withColumn("source", _is_source(F.col("vid"), sources)), faces, kernel, "vid long, distance double")


def anisotropic_laplacian(vertices: DataFrame, faces: DataFrame, anisotropy: float = 1.0, direction: str | float = "max", neighbours: int = 15) -> DataFrame:
    """Entries (shape_id, i, j, w): cotangent weights times 1 + a (d.e)^2, d the direction of most or least spread around the vertex and e the edge's direction; both ends are averaged, so that the matrix stays symmetric.

    ``direction`` may also be an angle, from the first of these directions to the second.
    """

    turn = {"max": 0.0, "min": np.pi / 2}.get(direction, direction)

    def kernel(p, q):
        v, ids = xyz(p), p["vid"].to_numpy()
        lap, _ = _cotangent(v, np.searchsorted(ids, q[["i0", "i1", "i2"]].to_numpy()))
        near = v[nearest(v, neighbours)[0]]
        near = near - near.mean(axis=1, keepdims=True)
        axes = np.linalg.eigh(np.einsum("nki,nkj->nij", near, near))[1]
        d = np.cos(turn) * axes[:, :, 2] + np.sin(turn) * axes[:, :, 1]
        off = lap.i != lap.j
        key, inverse = np.unique(lap.i[off] * lap.n + lap.j[off], return_inverse=True)
        w = np.bincount(inverse, lap.w[off], len(key))
        i, j = key // lap.n, key % lap.n
        e = v[j] - v[i]
        e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-20)
        w = w * (1 + anisotropy * (np.square((d[i] * e).sum(axis=1)) + np.square((d[j] * e).sum(axis=1))) / 2)
        diag = -np.bincount(i, w, lap.n)
        every = np.arange(lap.n)
        return {"i": ids[np.concatenate([i, every])], "j": ids[np.concatenate([j, every])], "w": np.concatenate([w, diag])}

    return per_pair(vertices, faces, kernel, "i long, j long, w double")


def _anisotropic_eig(vertices: DataFrame, faces: DataFrame, k: int, anisotropy: float, direction: str | float) -> DataFrame:
    return decompose(anisotropic_laplacian(vertices, faces, anisotropy, direction), geometry.vertex_areas(vertices, faces), k)


def anisotropic_hks(vertices: DataFrame, faces: DataFrame, k: int = 50, n_times: int = 50, anisotropy: float = 0.5, direction: str | float = "max") -> DataFrame:
    """Heat kernel signature (shape_id, vid, t, time, hks) of the anisotropic Laplacian."""
    return spectral.hks(_anisotropic_eig(vertices, faces, k, anisotropy, direction), n_times)


def anisotropic_wks(vertices: DataFrame, faces: DataFrame, k: int = 50, n_energies: int = 50, anisotropy: float = 0.5, direction: str | float = "max") -> DataFrame:
    """Wave kernel signature (shape_id, vid, e, wks) of the anisotropic Laplacian."""
    return spectral.wks(_anisotropic_eig(vertices, faces, k, anisotropy, direction), n_energies=n_energies)


def anisotropic_wavelets(vertices: DataFrame, faces: DataFrame, scales: list[float], k: int = 50, n_directions: int = 4, anisotropy: float = 0.5, kernel: str = "mexican_hat") -> DataFrame:
    """(shape_id, vid, direction, s, value): wavelet energies of the anisotropic Laplacian for directions that divide a half turn equally."""
    parts = [spectral.wavelet_descriptor(_anisotropic_eig(vertices, faces, k, anisotropy, np.pi * i / n_directions), scales, kernel).withColumn("direction", F.lit(i)) for i in range(n_directions)]
    return functools.reduce(DataFrame.unionByName, parts).select("shape_id", "vid", "direction", "s", "value")


def chebyshev_series(kernel, degree: int, top: float) -> np.ndarray:
    """Coefficients of the polynomial of this degree that meets the kernel at the extrema of the Chebyshev polynomial on [0, top], by a fast Fourier transform."""
    at = (1 + np.cos(np.pi * np.arange(degree + 1) / degree)) * top / 2
    y = np.broadcast_to(kernel(at), at.shape)
    c = np.fft.rfft(np.concatenate([y, y[-2:0:-1]])).real / degree
    c[[0, -1]] /= 2
    return c


def sgw_transform(entries: DataFrame, signal: DataFrame, scales: list[float], kernel=lambda x: x * np.exp(-x), order: int = 30) -> DataFrame:
    """(shape_id, vid, s, value): g(scale L) applied to a signal (shape_id, vid, value) by Chebyshev polynomials; no eigenpairs are needed."""

    def run(f, e):
        m, x = _matrix(e, f["vid"].to_numpy()), f["value"].to_numpy(float)
        top = max(float(np.bincount(m.i, np.abs(m.w), m.n).max()), 1e-12)
        flat = lambda y: (2 * (m @ y) - top * y) / top
        terms = [x, flat(x)]
        while len(terms) <= order:
            terms.append(2 * flat(terms[-1]) - terms[-2])
        out = [chebyshev_series(lambda y, t=t: kernel(t * y), order, top) @ np.stack(terms) for t in scales]
        return {"vid": np.tile(f["vid"], len(scales)), "s": np.repeat(np.arange(len(scales)), len(f)), "value": np.concatenate(out)}

    return per_pair(signal.select("shape_id", "vid", "value"), entries.select("shape_id", "i", "j", "w"), run, "vid long, s int, value double", ("vid", "i"))


def functional_map(eig_a: DataFrame, eig_b: DataFrame, fields: DataFrame, n_basis: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """C of n_basis x n_basis that carries spectral coefficients of shape a to b, by ridge regression on paired fields (side, vid, d, value).

    The coefficients are summed on the cluster; the driver solves a system
    of n_basis unknowns.
    """
    def coefficients(eig, side):
        phi = eig.select("vid", F.posexplode(F.slice("phi", 1, n_basis)).alias("k", "p"))
        rows = phi.join(fields.where(F.col("side") == side), "vid").groupBy("k", "d").agg(F.sum(F.col("p") * F.col("value")).alias("c")).collect()
        out = np.zeros((n_basis, 1 + max((r.d for r in rows), default=0)))
        for r in rows:
            out[r.k, r.d] = r.c
        return out

    a, b = coefficients(eig_a, "a"), coefficients(eig_b, "b")
    return b @ a.T @ np.linalg.inv(a @ a.T + ridge * np.eye(n_basis))


def shape_difference(c: np.ndarray, kind: str = "area") -> np.ndarray:
    """C'C, less the identity for the conformal kind."""
    return c.T @ c - (np.eye(c.shape[1]) if kind == "conformal" else 0)


def dwks(eig: DataFrame, difference: np.ndarray, n_energies: int = 50) -> DataFrame:
    """(shape_id, vid, e, value): wave kernel signature in the eigenbasis of a shape difference operator, over log-spaced eigenvalues."""
    mu, psi = np.linalg.eigh((difference + difference.T) / 2)
    mu = np.log(np.maximum(mu, 1e-10))
    sigma = max(7 * (mu.max() - mu.min()) / n_energies, 1e-6)
    g = np.exp(-np.square(np.linspace(mu.min(), mu.max(), n_energies)[:, None] - mu) / (2 * sigma**2))
    g = g / g.sum(axis=1, keepdims=True)
    lit = lambda m: F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in m))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    turned = F.transform(lit(psi.T), lambda row: F.pow(dot(row, F.slice("phi", 1, len(mu))), F.lit(2.0)))
    return eig.select("shape_id", "vid", turned.alias("q")).select("shape_id", "vid", F.posexplode(F.transform(lit(g), lambda row: dot(row, F.col("q")))).alias("e", "value"))
