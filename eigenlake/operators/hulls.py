"""Convex hulls and surfaces of volumes; a shape is one task."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame

from .kernels import per_shape, xyz


def _hull(p: np.ndarray) -> np.ndarray:
    """Faces, seen from outside in a left turn, of the convex hull of points; none if they lie in a plane.

    Each face keeps the points outside it; the farthest of them replaces the
    faces it sees by a fan from their rim.
    """
    size = np.abs(p - p.mean(axis=0)).max(initial=0)
    eps = 1e-10 * max(size, 1e-300)
    if len(p) < 4:
        return np.empty((0, 3), int)
    a = int(p[:, 0].argmin())
    b = int(np.square(p - p[a]).sum(axis=1).argmax())
    line = (p[b] - p[a]) / max(np.linalg.norm(p[b] - p[a]), 1e-300)
    off = np.linalg.norm(np.cross(p - p[a], line), axis=1)
    c = int(off.argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    height = (p - p[a]) @ normal / max(np.linalg.norm(normal), 1e-300)
    d = int(np.abs(height).argmax())
    if off[c] <= eps or abs(height[d]) <= eps:
        return np.empty((0, 3), int)
    centre = p[[a, b, c, d]].mean(axis=0)

    def plane(f: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        n = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
        n = n / max(np.linalg.norm(n), 1e-300)
        return n, float(n @ p[f[0]])

    faces: dict[tuple[int, int, int], tuple[np.ndarray, float, np.ndarray]] = {}

    def add(f: tuple[int, int, int], among: np.ndarray) -> None:
        n, at = plane(f)
        faces[f] = n, at, among[p[among] @ n - at > eps]

    every = np.arange(len(p))
    for f in itertools.combinations((a, b, c, d), 3):
        n, at = plane(f)
        add(f if n @ centre < at else (f[0], f[2], f[1]), every)
    while True:
        f = next((f for f, x in faces.items() if len(x[2])), None)
        if f is None:
            return np.array(list(faces))
        n, at, outside = faces[f]
        top = int(outside[(p[outside] @ n).argmax()])
        seen = [g for g, (m, h, _) in faces.items() if p[top] @ m - h > eps]
        among = np.unique(np.concatenate([faces[g][2] for g in seen]))
        ways = {e for g in seen for e in zip(g, (*g[1:], g[0]), strict=True)}
        for g in seen:
            del faces[g]
        for u, v in ways:
            if (v, u) not in ways:
                add((u, v, top), among)


def convex_hull(points: DataFrame) -> DataFrame:
    """(shape_id, area, volume, faces) of the convex hull of points (shape_id, vid, x, y, z); zeros for points in a plane."""

    def kernel(r):
        p = xyz(r)
        f = _hull(p)
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        volume = ((p[f[:, 0]] - p.mean(axis=0)) * n).sum() / 6
        return {"area": [np.linalg.norm(n, axis=1).sum() / 2], "volume": [float(volume)], "faces": [len(f)]}

    return per_shape(points, kernel, "area double, volume double, faces int")


def _tetrahedra() -> np.ndarray:
    """The six tetrahedra of a cube around its diagonal: corner numbers i + 2 j + 4 k."""
    return np.array([[0, 1 << o[0], (1 << o[0]) + (1 << o[1]), 7] for o in itertools.permutations(range(3))])


def isosurface(volumes: DataFrame, level: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the surface at a level, from voxels (shape_id, i, j, k, value, x, y, z); voxels that aren't listed are 0.

    Cells are cut into tetrahedra, so a closed body gives a closed surface.
    Vertices lie on edges between voxels, by linear interpolation; positions
    are those of the voxels' affine, fitted from the listed ones.  A shape
    is one task.
    """

    def build(r) -> tuple[np.ndarray, np.ndarray]:
        at = r[["i", "j", "k"]].to_numpy(int)
        lo = at.min(axis=0) - 1
        grid = np.zeros(at.max(axis=0) - lo + 2)
        grid[tuple((at - lo).T)] = r["value"].to_numpy(float)
        shape = np.array(grid.shape)
        cells = np.stack(np.meshgrid(*(np.arange(n - 1) for n in shape), indexing="ij"), axis=-1).reshape(-1, 3)
        corner = np.array([[c & 1, c >> 1 & 1, c >> 2 & 1] for c in range(8)])
        number = lambda q: np.ravel_multi_index(tuple(np.moveaxis(q, -1, 0)), shape)
        inside = grid.reshape(-1) > level
        ids = number(cells[:, None, :] + corner)
        mixed = inside[ids].any(axis=1) & ~inside[ids].all(axis=1)
        tets = ids[mixed][:, _tetrahedra()].reshape(-1, 4)
        triangles = []
        for t in tets:
            inn, out = t[inside[t]], t[~inside[t]]
            if len(inn) == 1 or len(out) == 1:
                one, three = (inn[0], out) if len(inn) == 1 else (out[0], inn)
                triangles.append([(one, x) for x in three])
            elif len(inn) == 2:
                (a, b), (c, d) = inn, out
                triangles += [[(a, c), (a, d), (b, d)], [(a, c), (b, d), (b, c)]]
        if not triangles:
            return np.empty((0, 3)), np.empty((0, 3), int)
        ends = np.sort(np.array(triangles).reshape(-1, 2), axis=1)
        edge, face = np.unique(ends, axis=0, return_inverse=True)
        value = grid.reshape(-1)
        share = (level - value[edge[:, 0]]) / (value[edge[:, 1]] - value[edge[:, 0]])
        place = lambda n: np.stack(np.unravel_index(n, shape), axis=1) + lo
        v = place(edge[:, 0]) * (1 - share[:, None]) + place(edge[:, 1]) * share[:, None]
        f = face.reshape(-1, 3)
        # outwards: away from the mean of each triangle's inner ends
        pairs = np.array(triangles)
        inner = np.where(inside[pairs[..., 0]], pairs[..., 0], pairs[..., 1])
        within = place(inner.reshape(-1)).reshape(-1, 3, 3).mean(axis=1)
        n = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
        back = (n * (v[f].mean(axis=1) - within)).sum(axis=1) < 0
        f[back] = f[back][:, ::-1]
        fit = np.linalg.lstsq(np.column_stack([at, np.ones(len(at))]), xyz(r), rcond=None)[0]
        return np.column_stack([v, np.ones(len(v))]) @ fit, f

    def vertices(r):
        v, _ = build(r)
        return {"vid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]}

    def faces(r):
        _, f = build(r)
        return {"fid": np.arange(len(f)), "i0": f[:, 0], "i1": f[:, 1], "i2": f[:, 2]}

    rows = volumes.select("shape_id", "i", "j", "k", "value", "x", "y", "z")
    return per_shape(rows, vertices, "vid long, x double, y double, z double", "i"), per_shape(rows, faces, "fid long, i0 long, i1 long, i2 long", "i")
