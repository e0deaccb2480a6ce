"""Parcels of a surface, and maps carried from one sphere to another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import nearest, per_pair, xyz


def apply_parcellation(vertices: DataFrame, faces: DataFrame, labels: DataFrame, ignore: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (shape_id, label, vid, x, y, z) and faces (shape_id, label, fid, i0, i1, i2) of each parcel.

    A face belongs to a parcel if all its corners do.  Parcels of fewer than
    three vertices or without such a face are left out, as are those in
    ``ignore`` and vertices without a label.  Ids stay; see ``renumbered``.
    """
    own = labels.select("shape_id", "vid", "label").where(F.col("label").isNotNull())
    own = own.where(~F.col("label").isin(ignore)) if ignore else own
    inside = vertices.join(own, ["shape_id", "vid"]).select("shape_id", "label", "vid", "x", "y", "z")
    whole = faces
    for i in range(3):
        whole = whole.join(own.select("shape_id", F.col("vid").alias(f"i{i}"), F.col("label").alias(f"l{i}")), ["shape_id", f"i{i}"])
    whole = whole.where("l0 = l1 and l1 = l2").select("shape_id", F.col("l0").alias("label"), "fid", "i0", "i1", "i2")
    enough = inside.groupBy("shape_id", "label").agg(F.count("*").alias("n")).where("n >= 3").join(whole.select("shape_id", "label").distinct(), ["shape_id", "label"]).select("shape_id", "label")
    return inside.join(enough, ["shape_id", "label"], "left_semi"), whole.join(enough, ["shape_id", "label"], "left_semi")


def summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(shape_id, label, n_vertices, n_faces) of parcels as ``apply_parcellation`` gives them."""
    n = vertices.groupBy("shape_id", "label").agg(F.count("*").alias("n_vertices"))
    return n.join(faces.groupBy("shape_id", "label").agg(F.count("*").alias("n_faces")), ["shape_id", "label"])


def carried(values: DataFrame, source: DataFrame, target: DataFrame, method: str = "nearest", k: int = 3) -> DataFrame:
    """(shape_id, vid, value): values (shape_id, vid, value) of each shape at the vertices of a common target sphere (vid, x, y, z).

    ``source`` are the shapes' own sphere coordinates (shape_id, vid, x, y, z).
    nearest takes the nearest source vertex (equal distances by vid), inverse
    the k nearest, weighted by one over the distance, which is kept above
    1e-12.  Labels are carried by nearest.  Source vertices without a value
    don't count, a shape without values gives no rows.  A shape is one task.
    """
    if method not in ("nearest", "inverse"):
        raise ValueError(f"unknown method {method}")
    rows = source.join(values.where(F.col("value").isNotNull()), ["shape_id", "vid"]).select("shape_id", "vid", "x", "y", "z", F.col("value").cast("double").alias("value"))
    wanted = target.select(F.col("vid").alias("to"), "x", "y", "z").crossJoin(F.broadcast(values.select("shape_id").distinct()))  # the result has these rows

    def kernel(s, t):
        near, far = nearest(xyz(s), 1 if method == "nearest" else k, xyz(t))
        y = s["value"].to_numpy()[near]
        if method == "nearest":
            return {"vid": t["to"], "value": y[:, 0]}
        w = 1 / np.maximum(far, 1e-12)
        return {"vid": t["to"], "value": (y * w).sum(axis=1) / w.sum(axis=1)}

    return per_pair(rows, wanted, kernel, "vid long, value double", ("vid", "to"))


def at_voxels(vertices: DataFrame, volume: DataFrame, affine: list[float]) -> DataFrame:
    """(shape_id, vid, value): the voxel (i, j, k, value) in which each vertex lies, 0 outside; ``affine`` has the 12 or 16 entries from voxel to world."""
    m = np.eye(4)
    m.flat[: len(affine)] = affine
    back = np.linalg.inv(m)
    place = lambda r: F.round(sum((F.col(c) * float(back[r, d]) for d, c in enumerate("xyz")), F.lit(float(back[r, 3])))).cast("int")
    at = vertices.select("shape_id", "vid", *(place(r).alias(c) for r, c in enumerate("ijk")))
    return at.join(volume.select("i", "j", "k", "value"), ["i", "j", "k"], "left").select("shape_id", "vid", F.coalesce("value", F.lit(0)).alias("value"))
