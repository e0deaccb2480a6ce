"""The tables behind figures: histograms, densities, curves, intervals and maps, ready to be drawn by whatever draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import per_pair
from .order import all_pairs, running


def _joined(rows: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(one, by) if by else rows.crossJoin(F.broadcast(one))  # of one row


def histogram(rows: DataFrame, value: str, bins: int = 50, low: float | None = None, high: float | None = None, *by: str) -> DataFrame:
    """(by..., bin, left, n, density): equal bins from the least to the largest value of each key (or ``low`` to ``high``), the last one closed; empty bins have no row, nulls and values outside don't count."""
    x = rows.select(*by, F.col(value).cast("double").alias("x")).where("x is not null")
    ends = x.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = ends.withColumn("lo", F.lit(float(low))) if low is not None else ends
    ends = ends.withColumn("hi", F.lit(float(high))) if high is not None else ends
    width = (F.col("hi") - F.col("lo")) / bins
    at = _joined(x, ends, list(by)).where("x between lo and hi")
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = at.groupBy(*by, place.alias("bin"), "lo", width.alias("width")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return _joined(counts, total, list(by)).select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "n", (F.col("n") / F.col("total") / F.nullif("width", F.lit(0.0))).alias("density"))


def density(rows: DataFrame, value: str, points: int = 100, bandwidth: float | None = None, *by: str) -> DataFrame:
    """(by..., i, x, density): Gaussian kernel densities of each key on a grid from three widths below the least value to three above the largest.

    The width is Scott's (deviation times n^(-1/5)) unless given; a key
    without spread has no row.  Each value meets each point of the grid inside its task.
    """
    v = rows.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    width = F.lit(float(bandwidth)) if bandwidth else F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2))
    s = v.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), width.alias("h")).where("h > 0")
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    at = _joined(v, s, list(by)).select(*by, "v", "lo", "hi", "n", "h", F.explode(grid).alias("i"))
    x = F.col("lo") - 3 * F.col("h") + F.col("i") * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1)
    kernel = F.exp(-F.pow((x - F.col("v")) / F.col("h"), F.lit(2.0)) / 2) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return at.groupBy(*by, "i", x.alias("x")).agg(F.sum(kernel).alias("density"))


def volcano(tests: DataFrame, effect: str, p: str = "p", alpha: float = 0.05, least: float = 0.5) -> DataFrame:
    """Tests with ``height`` = -log10 p (p kept above 1e-300) and ``marked``: p below alpha and the effect beyond ``least``."""
    return tests.withColumn("height", -F.log10(F.greatest(p, F.lit(1e-300)))).withColumn("marked", (F.col(p) < alpha) & (F.abs(effect) > least))


def roc_curve(scores: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr): shares of the negatives and positives (y 0 or 1) whose score s is at least the threshold, for each score that occurs."""
    counts = scores.where("s is not null and y in (0, 1)").groupBy("s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    at = running(counts, "s", "p", "q")
    share = lambda c: (F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)) / F.nullif(F.col(f"{c}_all"), F.lit(0))
    return at.select(F.col("s").alias("threshold"), share("q").alias("fpr"), share("p").alias("tpr"))


def area_under(scores: DataFrame) -> DataFrame:
    """(auc): the trapezoids under ``roc_curve``."""
    counts = scores.where("s is not null and y in (0, 1)").groupBy("s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    at = running(counts, "s", "p", "q")
    step = F.col("q") * (F.col("p_all") - F.col("p_upto") + F.col("p") / 2)
    return at.agg((F.sum(step) / F.nullif(F.max(F.col("p_all") * F.col("q_all")).cast("double"), F.lit(0.0))).alias("auc"))


def full_matrix(pairs: DataFrame, value: str = "d", diagonal: float = 0.0) -> DataFrame:
    """(i, j, value) of the whole symmetric matrix of pairs (a, b, value), diagonal included, as a heat map needs it."""
    v = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col(value).alias("value"))
    nodes = v.select(F.explode(F.array("i", "j")).alias("i")).distinct()
    return v.unionByName(v.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(diagonal).alias("value")))


def share_beyond(rows: DataFrame, value: str, least: float, *by: str) -> DataFrame:
    """(by..., n, beyond, share) of the values whose size is more than ``least``."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.abs(value) > least).alias("beyond"), F.avg((F.abs(value) > least).cast("double")).alias("share"))


def sides(pairs: DataFrame) -> DataFrame:
    """Rows (..., side, value) for left and right of each pair (..., left, right)."""
    others = [c for c in pairs.columns if c not in ("left", "right")]
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).cast("double").alias("value")) for s in ("left", "right")))
    return pairs.select(*others, F.explode(both).alias("e")).select(*others, "e.*")


def intervals(draws: DataFrame, value: str = "value", mass: float = 0.94, *by: str) -> DataFrame:
    """(by..., mean, low, high, n): mean and narrowest interval that holds ``mass`` of a parameter's draws (the leftmost of equals); a parameter is one task, as its draws are the sampler's output."""
    w = Window.partitionBy(*by).orderBy(value)
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = draws.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.row_number().over(w).alias("i"), total.alias("n"))
    span = F.greatest(F.ceil(F.col("n") * mass).cast("int") - 1, F.lit(0))
    ends = placed.select(*by, F.col("v").alias("hi"), F.col("i").alias("j"))
    start = placed.select(*by, F.col("v").alias("lo"), "n", "i", (F.col("i") + span).alias("j"))
    held = start.join(ends, [*by, "j"])
    best = held.groupBy(*by).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "lo", "hi")).alias("b"))
    mean = placed.groupBy(*by).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    return _joined(mean, best, list(by)).select(*by, "mean", F.col("b.lo").alias("low"), F.col("b.hi").alias("high"), "n")


def decision(draws: DataFrame, value: str, low: float, high: float, *by: str) -> DataFrame:
    """(by..., below, inside, above): shares of the draws on each side of and within a region of practical equivalence."""
    share = lambda c: F.avg(c.cast("double"))
    x = F.col(value)
    return draws.groupBy(*by).agg(share(x < low).alias("below"), share((x >= low) & (x <= high)).alias("inside"), share(x > high).alias("above"))


def masked(rows: DataFrame, value: str = "z", threshold: float = 2.0) -> DataFrame:
    """Rows with ``shown``: the value where its size is beyond the threshold, else null."""
    return rows.withColumn("shown", F.when(F.abs(value) > threshold, F.col(value)))


def boundaries(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(shape_id, u, v): edges whose ends have different labels."""
    at = lambda end: labels.select("shape_id", F.col("vid").alias(end), F.col("label").alias(f"l{end}"))
    return edges.select("shape_id", "u", "v").join(at("u"), ["shape_id", "u"]).join(at("v"), ["shape_id", "v"]).where("lu <> lv").select("shape_id", "u", "v")


def leading(weights: DataFrame, n: int = 4) -> DataFrame:
    """(shape_id, component, total): the n components of weights (shape_id, vid, weights array) with the largest sums; equal ones by number."""
    sums = weights.select("shape_id", F.posexplode("weights").alias("component", "w")).groupBy("shape_id", "component").agg(F.sum("w").alias("total"))
    place = F.row_number().over(Window.partitionBy("shape_id").orderBy(F.desc("total"), "component"))  # one row a component
    return sums.withColumn("place", place).where(F.col("place") <= n).drop("place")


def exploded(points: DataFrame, labels: DataFrame, factor: float = 0.5) -> DataFrame:
    """Points (shape_id, vid, label, x, y, z) moved by ``factor`` times the way from the shape's centroid to their cluster's."""
    axes = ("x", "y", "z")
    rows = points.join(labels.select("shape_id", "vid", "label"), ["shape_id", "vid"])
    whole = rows.groupBy("shape_id").agg(*(F.avg(c).alias(f"{c}0") for c in axes))
    part = rows.groupBy("shape_id", "label").agg(*(F.avg(c).alias(f"{c}1") for c in axes))
    moved = [(F.col(c) + factor * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in axes]
    return rows.join(part, ["shape_id", "label"]).join(whole, "shape_id").select("shape_id", "vid", "label", *moved)


def profiles(descriptors: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, t, mean, sem, n): mean and standard error (population deviation over the root of n) of each entry of descriptors (shape_id, vid, f) by cluster."""
    at = descriptors.join(labels.select("shape_id", "vid", "label"), ["shape_id", "vid"]).select("label", F.posexplode("f").alias("t", "x"))
    return at.groupBy("label", "t").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") / F.sqrt(F.count("x"))).alias("sem"), F.count("x").alias("n"))


def sizes(labels: DataFrame, *by: str) -> DataFrame:
    """(by..., label, n, noise): members of each label; -1 is noise."""
    return labels.groupBy(*by, "label").agg(F.count("*").alias("n")).withColumn("noise", F.col("label") == -1)


def agreement(labels: DataFrame) -> DataFrame:
    """(a, b, ari): adjusted Rand index of each two methods, of labels (method, vid, label), over the vertices that both have."""
    pair = lambda n: n * (n - 1) / 2
    x = labels.select(F.col("method").alias("a"), "vid", F.col("label").alias("la"))
    y = labels.select(F.col("method").alias("b"), "vid", F.col("label").alias("lb"))
    cells = x.join(y, "vid").where("a < b").groupBy("a", "b", "la", "lb").agg(F.count("*").cast("double").alias("n"))
    side = lambda c, out: cells.groupBy("a", "b", c).agg(F.sum("n").alias("m")).groupBy("a", "b").agg(F.sum(pair(F.col("m"))).alias(out))
    s = cells.groupBy("a", "b").agg(F.sum(pair(F.col("n"))).alias("both"), F.sum("n").alias("n")).join(side("la", "pa"), ["a", "b"]).join(side("lb", "pb"), ["a", "b"])
    chance = F.col("pa") * F.col("pb") / F.nullif(pair(F.col("n")), F.lit(0.0))
    gap = (F.col("pa") + F.col("pb")) / 2 - chance
    return s.select("a", "b", F.when(gap == 0, 1.0).otherwise((F.col("both") - chance) / gap).alias("ari"))


def hovmoller(points: DataFrame, fields: DataFrame, axis: str = "x", bins: int = 100) -> DataFrame:
    """(shape_id, bin, t, mean, n): a field (shape_id, vid, t, value) averaged in equal bins along an axis, the last bin closed."""
    ends = points.groupBy("shape_id").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(axis) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    at = points.join(ends, "shape_id").select("shape_id", "vid", place.alias("bin"))
    return at.join(fields, ["shape_id", "vid"]).groupBy("shape_id", "bin", "t").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shape_id, vid, value): a less b, where both have a value."""
    return a.select("shape_id", "vid", F.col("value").alias("p")).join(b.select("shape_id", "vid", F.col("value").alias("q")), ["shape_id", "vid"]).select("shape_id", "vid", (F.col("p") - F.col("q")).alias("value"))


def along_line(vertices: DataFrame, faces: DataFrame, start: tuple[float, float], end: tuple[float, float], samples: int = 50) -> DataFrame:
    """(shape_id, i, value): a field on an unfolded surface, vertices (shape_id, vid, x, y, value), at places along a line, linear within each face; null off the surface.

    Where faces overlap, the one of the smallest id counts.  A shape is one task.
    """

    def kernel(p, q):
        at = np.linspace(start, end, samples)
        ids, xy, y = p["vid"].to_numpy(), p[["x", "y"]].to_numpy(float), p["value"].to_numpy(float)
        f = np.searchsorted(ids, q[["i0", "i1", "i2"]].to_numpy())
        a, b, c = (xy[f[:, n]] for n in range(3))
        det = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])
        out = []
        for s in at:
            u = ((s[0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (s[1] - a[:, 1])) / np.where(det == 0, np.nan, det)
            v = ((b[:, 0] - a[:, 0]) * (s[1] - a[:, 1]) - (s[0] - a[:, 0]) * (b[:, 1] - a[:, 1])) / np.where(det == 0, np.nan, det)
            hit = np.flatnonzero((u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9))
            out.append(None if not len(hit) else float(y[f[hit[0]]] @ [1 - u[hit[0]] - v[hit[0]], u[hit[0]], v[hit[0]]]))
        return {"i": np.arange(samples), "value": out}

    return per_pair(vertices.select("shape_id", "vid", "x", "y", "value"), faces.select("shape_id", "fid", "i0", "i1", "i2"), kernel, "i int, value double")


def clipped(rows: DataFrame, value: str, low: Column | float, high: Column | float) -> DataFrame:
    """Rows with ``shade``: where the value lies between the two ends, from 0 to 1."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return rows.withColumn("shade", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))))


def agreement_of_matrices(matrices: DataFrame) -> DataFrame:
    """(a, b, r): correlation of each two matrices' entries, matrices (name, v array) of one length."""
    pairs = all_pairs(matrices, "name", "v")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + t) / F.size(x)
    dev = lambda x: F.transform(x, lambda t: t - mean(F.col(x)))
    rows = pairs.select("a", "b", dev("p").alias("p"), dev("q").alias("q"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return rows.select("a", "b", (dot("p", "q") / F.nullif(F.sqrt(dot("p", "p") * dot("q", "q")), F.lit(0.0))).alias("r"))
