"""Running NumPy kernels on whole shapes: one task a shape, so memory is bounded by the largest shape, not by the number of shapes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]


def per_shape(table: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], columns: str, order: str = "vid") -> DataFrame:
    """(shape_id, columns) of kernel(rows of a shape, sorted by ``order``)."""
    names = [c.split()[0] for c in columns.split(", ")]
    kind = table.schema["shape_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(order, kind="stable", ignore_index=True)
        out = pd.DataFrame(kernel(own))
        out["shape_id"] = rows["shape_id"].iloc[0]
        return out[["shape_id", *names]]

    return table.groupBy("shape_id").applyInPandas(run, f"shape_id {kind}, {columns}")


def per_pair(left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], columns: str, orders: tuple[str, str] = ("vid", "fid")) -> DataFrame:
    """(shape_id, columns) of kernel(rows of both tables of a shape); a shape without rows in ``left`` gives none."""
    names = [c.split()[0] for c in columns.split(", ")]
    kind = left.schema["shape_id"].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=["shape_id", *names])
        shape = a["shape_id"].iloc[0]
        out = pd.DataFrame(kernel(a.sort_values(orders[0], kind="stable", ignore_index=True), b.sort_values(orders[1], kind="stable", ignore_index=True)))
        out["shape_id"] = shape
        return out[["shape_id", *names]]

    left, right = (t.select(*(F.col(c).alias(c) for c in t.columns)) for t in (left, right))  # tables of one source need columns of their own
    return left.groupBy("shape_id").cogroup(right.groupBy("shape_id")).applyInPandas(run, f"shape_id {kind}, {columns}")


def xyz(rows: pd.DataFrame) -> np.ndarray:
    return rows[XYZ].to_numpy(np.float64)


def blocks(n: int, m: int, cells: int = 1 << 22) -> Iterator[slice]:
    """Slices of n rows so that each has about ``cells`` distances to m others."""
    step = max(1, cells // max(m, 1))
    return (slice(lo, min(n, lo + step)) for lo in range(0, n, step))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, from differences, so that equal points are at 0."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += np.square(a[:, d, None] - b[None, :, d])
    return out


def nearest(points: np.ndarray, k: int, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest points, equal distances by position; a point is its own neighbour when no query is given."""
    query = points if query is None else query
    k = min(k, len(points))
    at, far = np.empty((len(query), k), np.int64), np.empty((len(query), k))
    for s in blocks(len(query), len(points)) if k else ():
        d = squared(query[s], points)
        order = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
        few = np.take_along_axis(d, order, axis=1)
        order = np.take_along_axis(order, np.argsort(few, axis=1, kind="stable"), axis=1)
        tied = (d <= few.max(axis=1, keepdims=True)).sum(axis=1) != k  # equal distances at the end: the smallest positions
        order[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
        at[s], far[s] = order, np.sqrt(np.take_along_axis(d, order, axis=1))
    return at, far


def index_of(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of wanted ids in sorted ids."""
    return np.searchsorted(ids, wanted)
