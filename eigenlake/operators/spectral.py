"""Descriptors and distances read from eigenpairs.

Input rows are ``(shape_id, vid, lam array<double>, phi array<double>)``: the
eigenvalues of the shape and the vertex's entries of its eigenvectors.  What
concerns one vertex is an expression over the two arrays, so it needs no
shuffle; norms over a shape are aggregates joined back.  Descriptors over a
grid of times, energies or scales take one table of weights a spectrum and
multiply all vertices of an Arrow batch by it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import nearest, per_shape
from .order import all_pairs

#: Eigenvalues up to this count as zero.
ZERO = 1e-10


def with_eigenvalues(vectors: DataFrame, values: DataFrame) -> DataFrame:
    """(shape_id, vid, lam, phi) from eigenvectors (shape_id, vid, phi) and eigenvalues (shape_id, k, lambda)."""
    lam = values.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("lambda")))), lambda x: x["lambda"]).alias("lam"))
    return vectors.join(lam, "shape_id").select("shape_id", "vid", "lam", "phi")


def weighted_sum(weight, lam: Column | str = "lam", phi: Column | str = "phi") -> Column:
    """Sum over the eigenpairs of weight(lambda, phi)."""
    return F.aggregate(F.zip_with(lam, phi, weight), F.lit(0.0), lambda a, x: a + x)


def _by_spectrum(lam: pa.Array, phi: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Eigenvalues, rows and their matrix of phi, for each spectrum of a batch; rows without one entry a value are left out."""
    starts = [x.offsets.to_numpy() for x in (lam, phi)]
    values = [x.values.to_numpy(zero_copy_only=False) for x in (lam, phi)]
    sizes = [np.diff(x) for x in starts]
    whole = np.asarray(lam.is_valid()) & np.asarray(phi.is_valid()) & (sizes[0] == sizes[1]) & (sizes[0] > 0)
    groups: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(whole).tolist():
        groups.setdefault(values[0][starts[0][i] : starts[0][i + 1]].tobytes(), []).append(i)
    for own, rows in groups.items():
        n = len(own) // 8
        yield np.frombuffer(own), np.array(rows), values[1][starts[1][rows][:, None] + np.arange(n)]


def _on_grid(eig: DataFrame, points: int, of: Callable, at: str, names: list[str]) -> DataFrame:
    """(shape_id, vid, at, names) with ``points`` rows a vertex.

    ``of(lam, phi)`` gives for each name a vertices x points matrix, or one
    value a point.  A vertex whose arrays are null, empty or of different
    sizes has null values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                b = whole.slice(lo, 2000)
                lam, phi = (pa.concat_arrays([b.column(i).cast(pa.list_(pa.float64()))]) for i in (2, 3))
                out = {n: np.full((len(b), points), np.nan) for n in names}
                known = np.zeros(len(b), bool)
                for own, rows, matrix in _by_spectrum(lam, phi):
                    known[rows] = True
                    for n, x in of(own, matrix).items():
                        out[n][rows] = x
                missing = np.repeat(~known, points)
                rows = pa.array(np.repeat(np.arange(len(b)), points))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.tile(np.arange(points, dtype=np.int32), len(b))), *(pa.array(out[n].reshape(-1), mask=missing) for n in names)], ["shape_id", "vid", at, *names])

    kinds = [eig.schema[c].dataType.simpleString() for c in ("shape_id", "vid")]
    return eig.select("shape_id", "vid", "lam", "phi").mapInArrow(run, f"shape_id {kinds[0]}, vid {kinds[1]}, {at} int, " + ", ".join(f"{n} double" for n in names))


def auto_times(lam: np.ndarray, n: int) -> np.ndarray:
    """n diffusion times, log-spaced between 4 ln 10 over the largest and over the smallest positive eigenvalue, kept within 1e-6 and 1e6; 0.01 to 100 with fewer than two."""
    positive = lam[lam > ZERO]
    ends = (-2.0, 2.0) if len(positive) < 2 else (np.log10(max(1e-6, 4 * np.log(10) / positive.max())), np.log10(min(1e6, 4 * np.log(10) / positive.min())))
    return 10 ** np.linspace(*ends, n)


def _per_time(eig: DataFrame, n_times: int, times: list[float] | None, names: list[str], of: Callable) -> DataFrame:
    """(shape_id, vid, t, time, names); ``of(decay, phi)`` with the matrix exp(-lambda t) of times x eigenvalues."""

    def values(lam: np.ndarray, phi: np.ndarray) -> dict[str, np.ndarray]:
        grid = np.array(times) if times else auto_times(lam, n_times)
        return {"time": grid, **of(np.exp(-np.outer(grid, lam)), phi)}

    return _on_grid(eig, len(times) if times else n_times, values, "t", ["time", *names])


def hks(eig: DataFrame, n_times: int = 100, times: list[float] | None = None, normalize: bool = False) -> DataFrame:
    """Heat kernel signature (shape_id, vid, t, time, hks) over all eigenpairs, zero included; normalize divides each time's column by its L2 norm over the shape."""
    out = _per_time(eig, n_times, times, ["hks"], lambda decay, phi: {"hks": phi**2 @ decay.T})
    return _unit_columns(out, "t", "hks") if normalize else out


def _unit_columns(df: DataFrame, key: str, value: str) -> DataFrame:
    norms = df.groupBy("shape_id", key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    return df.join(norms, ["shape_id", key]).withColumn(value, F.col(value) / F.greatest("norm", F.lit(1e-30))).drop("norm").select(*df.columns)


def wks(eig: DataFrame, energies: list[float] | None = None, sigma: float | None = None, normalize: bool = True, n_energies: int = 100) -> DataFrame:
    """Wave kernel signature (shape_id, vid, e, wks): phi squared, weighted by a Gaussian of log lambda around each energy whose weights sum to 1; zero modes are skipped.

    Without energies, or without a width, those of ``wks_settings`` are taken.
    """

    def values(lam: np.ndarray, phi: np.ndarray) -> dict[str, np.ndarray]:
        logs = np.log(lam[lam > ZERO])
        lo, hi, own = (-2.0, 2.0, 1.0) if len(logs) < 2 else _settings(logs.min(), logs.max(), n_energies)
        at, width = np.linspace(lo, hi, n_energies) if energies is None else np.array(energies), own if sigma is None else sigma
        gauss = np.where(lam > ZERO, np.exp(-((at[:, None] - np.log(np.maximum(lam, ZERO))) ** 2) / max(2 * width * width, 1e-300)), 0.0)
        return {"wks": phi**2 @ (gauss / np.maximum(gauss.sum(axis=1, keepdims=True), 1e-30)).T}

    out = _on_grid(eig, n_energies if energies is None else len(energies), values, "e", ["wks"])
    return _unit_columns(out, "e", "wks") if normalize else out


def _settings(a: float, b: float, n: int) -> tuple[float, float, float]:
    step = (b - a) / n
    return (a + 14 * step, b - 14 * step, 7 * step) if n > 28 and b > a else (a, b, step / 2)


def wks_settings(values: DataFrame, n_energies: int = 100) -> DataFrame:
    """(shape_id, lo, hi, sigma) of eigenvalues (shape_id, k, lambda): ends of the energies and the width.

    The width is 7 steps of the log range and the ends lie two widths inside
    it; where that leaves nothing (28 energies or fewer) they are the whole
    range, at half a step.  Fewer than two positive eigenvalues give -2, 2 and 1.
    """
    logs = F.when(F.col("lambda") > ZERO, F.log("lambda"))
    ends = values.groupBy("shape_id").agg(F.min(logs).alias("a"), F.max(logs).alias("b"), F.count(logs).alias("n"))
    step = (F.col("b") - F.col("a")) / n_energies
    inside = F.lit(28) < n_energies
    pick = lambda few, wide, inner: F.when(F.col("n") < 2, F.lit(few)).when(inside & (F.col("b") > F.col("a")), inner).otherwise(wide)
    return ends.select("shape_id", pick(-2.0, F.col("a"), F.col("a") + 14 * step).alias("lo"), pick(2.0, F.col("b"), F.col("b") - 14 * step).alias("hi"), pick(1.0, step / 2, 7 * step).alias("sigma"))


def gps(eig: DataFrame) -> DataFrame:
    """Global point signature (shape_id, vid, gps array): phi over the root of lambda, without the first pair."""
    pairs = F.zip_with("lam", "phi", lambda l, p: p / F.sqrt(F.greatest(l, F.lit(ZERO))))
    return eig.select("shape_id", "vid", F.slice(pairs, 2, 1 << 30).alias("gps"))


def bks(eig: DataFrame) -> DataFrame:
    """Biharmonic signature (shape_id, vid, bks): phi squared over lambda squared, zero modes skipped."""
    return eig.select("shape_id", "vid", weighted_sum(lambda l, p: F.when(l > ZERO, p * p / (l * l)).otherwise(0.0)).alias("bks"))


def bates(eig: DataFrame, n_times: int = 10, times: list[float] | None = None) -> DataFrame:
    """Elementary symmetric sums of order 1 to 3 of exp(-lambda t) phi (shape_id, vid, t, time, e1, e2, e3), by power sums."""

    def sums(decay: np.ndarray, phi: np.ndarray) -> dict[str, np.ndarray]:
        p1, p2, p3 = (phi**n @ (decay**n).T for n in (1, 2, 3))
        return {"e1": p1, "e2": (p1 * p1 - p2) / 2, "e3": (p1 * p1 * p1 - 3 * p1 * p2 + 2 * p3) / 6}

    return _per_time(eig, n_times, times, ["e1", "e2", "e3"], sums)


def si_hks(eig: DataFrame, n_times: int = 256, n_frequencies: int = 8) -> DataFrame:
    """Scale-invariant HKS (shape_id, vid, f, value): magnitudes of the Fourier bins 1..n of the differences of log HKS along log time."""

    def values(lam: np.ndarray, phi: np.ndarray) -> dict[str, np.ndarray]:
        heat = phi**2 @ np.exp(-np.outer(lam, auto_times(lam, n_times)))
        steps = np.diff(np.log(np.maximum(heat, 1e-30)), axis=1)
        angle = 2 * np.pi * np.outer(np.arange(n_times - 1), np.arange(1, n_frequencies + 1)) / (n_times - 1)
        return {"value": np.hypot(steps @ np.cos(angle), steps @ np.sin(angle))}

    out = _on_grid(eig, n_frequencies, values, "f", ["value"])
    return out.withColumn("f", F.col("f") + 1)


def _meyer(x: np.ndarray) -> np.ndarray:
    """A bump on 1/2 to 2 with its top at 1: a smooth step up to 1 times one down from 1."""
    turn = lambda y: np.pi / 2 * np.polyval([-20, 70, -84, 35, 0, 0, 0, 0], np.clip(y, 0, 1))
    return (np.sin(turn(2 * x - 1)) * np.cos(turn(x - 1))) ** 2


#: Kernels of spectral graph wavelets, of scale times eigenvalue.
WAVELETS = {
    "mexican_hat": lambda x: x * np.exp(-x),
    "heat": lambda x: np.exp(-x),
    "band": lambda x: np.where((x > 0.5) & (x < 2.0), np.sin(np.pi * (x - 0.5) / 1.5), 0.0),
    "meyer": _meyer,
}


def wavelet_descriptor(eig: DataFrame, scales: list[float], kernel: str = "mexican_hat") -> DataFrame:
    """Energy of spectral graph wavelets (shape_id, vid, s, value): sum of (g(s lambda) phi)^2, by a kernel of ``WAVELETS``."""
    if kernel not in WAVELETS:
        raise ValueError(f"unknown kernel {kernel}")
    g = WAVELETS[kernel]
    return _on_grid(eig, len(scales), lambda lam, phi: {"value": phi**2 @ (g(np.outer(lam, np.array(scales))) ** 2)}, "s", ["value"])


def ibks(eig: DataFrame, alpha: float = 0.1, neighbours: int = 10, curvature: DataFrame | None = None) -> DataFrame:
    """Improved biharmonic signature (shape_id, vid, ibks): bks plus alpha times the mean of curvature x bks over the nearest vertices.

    Nearness is in the first ten entries of phi, a vertex is its own
    neighbour, equal distances go by vid.  ``curvature`` is (shape_id, vid,
    curvature); without it the root of the sum of lambda phi^2 over the first
    ten modes that aren't zero stands in.  A shape is one task.
    """
    modes = F.slice(F.filter(F.zip_with("lam", "phi", lambda l, p: F.when(l > ZERO, l * p * p)), lambda x: x.isNotNull()), 1, 10)
    proxy = F.sqrt(F.aggregate(modes, F.lit(0.0), lambda a, x: a + x))
    rows = bks(eig).join(eig.select("shape_id", "vid", F.slice("phi", 1, 10).alias("f"), proxy.alias("proxy")), ["shape_id", "vid"])
    rows = rows.join(curvature.select("shape_id", "vid", F.abs("curvature").alias("c")), ["shape_id", "vid"]) if curvature is not None else rows.withColumn("c", F.col("proxy"))

    def kernel(r):
        near = nearest(np.stack(r["f"].to_numpy()).astype(float), neighbours)[0]
        b = r["bks"].to_numpy()
        return {"vid": r["vid"], "ibks": b + alpha * (r["c"].to_numpy() * b)[near].mean(axis=1)}

    return per_shape(rows.select("shape_id", "vid", "f", "bks", "c"), kernel, "vid long, ibks double")


def all_descriptors(eig: DataFrame, n_times: int = 100, n_energies: int = 100, n_frequencies: int = 8, bates_times: int = 10, curvature: DataFrame | None = None) -> DataFrame:
    """(shape_id, vid, descriptor, i, value): the signatures of this module in one long table."""
    one = lambda df, name, i, value: df.select("shape_id", "vid", F.lit(name).alias("descriptor"), (F.col(i) if isinstance(i, str) else F.lit(i)).cast("int").alias("i"), F.col(value).alias("value"))
    e = bates(eig, bates_times)
    parts = [
        one(hks(eig, n_times), "hks", "t", "hks"),
        one(wks(eig, n_energies=n_energies), "wks", "e", "wks"),
        one(si_hks(eig, n_frequencies=n_frequencies), "si_hks", "f", "value"),
        one(gps(eig).select("shape_id", "vid", F.posexplode("gps").alias("k", "value")), "gps", "k", "value"),
        one(bks(eig), "bks", 0, "bks"),
        one(ibks(eig, curvature=curvature), "ibks", 0, "ibks"),
        *(one(e, f"bates_{n}", "t", n) for n in ("e1", "e2")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def truncated(values: DataFrame, k: int) -> DataFrame:
    """The first k eigenvalues (shape_id, k, lambda, ...) of each shape; a shape with fewer is an error when its rows are computed."""
    have = F.count(F.lit(1)).over(Window.partitionBy("shape_id"))
    checked = values.withColumn("_n", have).where(F.when(F.col("_n") < k, F.raise_error(F.concat(F.lit("fewer eigenpairs than asked for: "), F.col("_n").cast("string")))).otherwise(F.lit(True)).cast("boolean"))
    return checked.drop("_n").where(F.col("k") < k)


def gaps(values: DataFrame) -> DataFrame:
    """(shape_id, fiedler, gap): the second eigenvalue, and the third less the second; 0 where there are too few."""
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("lambda")))
    return values.groupBy("shape_id").agg(F.coalesce(at(1), F.lit(0.0)).alias("fiedler"), F.coalesce(at(2) - at(1), F.lit(0.0)).alias("gap"))


def normalized_values(values: DataFrame, method: str = "area") -> DataFrame:
    """(shape_id, k, value) of eigenvalues (shape_id, k, lambda, area or volume): times area, times volume^(2/3), or over the second one (fiedler)."""
    if method in ("area", "volume"):
        return values.select("shape_id", "k", (F.col("lambda") * (F.col("area") if method == "area" else F.pow("volume", F.lit(2 / 3)))).alias("value"))
    if method != "fiedler":
        raise ValueError(f"unknown normalisation {method}")
    return values.join(gaps(values), "shape_id").select("shape_id", "k", (F.col("lambda") / F.greatest("fiedler", F.lit(1e-30))).alias("value"))


def diffusion_distances(eig: DataFrame, landmarks: DataFrame, times: list[float]) -> DataFrame:
    """(shape_id, vid, to, t, time, distance): diffusion distances to landmarks at each of several times; phi differences are formed once a pair."""
    squared = F.zip_with("phi", "phi_to", lambda a, b: (a - b) * (a - b))
    at = eig.join(landmarks, "shape_id").select("shape_id", F.struct("vid", "to").alias("vid"), "lam", squared.alias("phi"))
    out = _on_grid(at, len(times), lambda lam, d: {"time": np.array(times), "distance": np.sqrt(np.maximum(d @ np.exp(-2 * np.outer(lam, np.array(times))), 0.0))}, "t", ["time", "distance"])
    return out.select("shape_id", "vid.vid", "vid.to", "t", "time", "distance")


def shapedna_distance(dna: DataFrame, metric: str = "euclidean", inverse: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) for all pairs a < b of shapes (shape_id, k, value), over their common length.

    cosine is 1 less the cosine, and 1 where a norm vanishes; mahalanobis
    takes ``inverse``, entries (i, j, w) of the inverse covariance.  A shape
    is one row here, and pairs meet in blocks.
    """
    if metric not in ("euclidean", "cosine", "mahalanobis"):
        raise ValueError(f"unknown metric {metric}")
    n = F.least(F.size("p"), F.size("q"))
    pairs = all_pairs(_as_rows(dna), "shape_id", "v").select("a", "b", F.slice("p", F.lit(1), n).alias("p"), F.slice("q", F.lit(1), n).alias("q"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    d = F.zip_with("p", "q", lambda s, t: s - t)
    if metric == "euclidean":
        return pairs.select("a", "b", F.sqrt(dot(d, d)).alias("distance"))
    if metric == "cosine":
        norms = F.sqrt(dot("p", "p")) * F.sqrt(dot("q", "q"))
        return pairs.select("a", "b", F.when(norms < 1e-20, 1.0).otherwise(1 - dot("p", "q") / norms).alias("distance"))
    if inverse is None:
        raise ValueError("mahalanobis needs the inverse covariance")
    at = lambda c: pairs.select("a", "b", F.posexplode(d).alias(c, f"d{c}"))
    terms = at("i").join(inverse.select("i", "j", "w"), "i").join(at("j"), ["a", "b", "j"])
    return terms.groupBy("a", "b").agg(F.sqrt(F.greatest(F.sum(F.col("di") * F.col("w") * F.col("dj")), F.lit(0.0))).alias("distance"))


def distance_to(eig: DataFrame, landmarks: DataFrame, kind: str = "biharmonic", t: float = 1.0) -> DataFrame:
    """Spectral distances (shape_id, vid, to, distance) from every vertex to a shape's landmarks (shape_id, to, phi_to).

    biharmonic weighs squared differences by 1/lambda^2, commute by 1/lambda,
    diffusion by exp(-2 lambda t); zero modes are skipped by the first two.
    """
    weights = {
        "biharmonic": lambda l: F.when(l > ZERO, 1 / (l * l)).otherwise(0.0),
        "commute": lambda l: F.when(l > ZERO, 1 / l).otherwise(0.0),
        "diffusion": lambda l: F.exp(-2 * l * t),
    }
    if kind not in weights:
        raise ValueError(f"unknown distance {kind}")
    squared = F.zip_with("phi", "phi_to", lambda a, b: (a - b) * (a - b))
    total = F.aggregate(F.zip_with("lam", squared, lambda l, d: weights[kind](l) * d), F.lit(0.0), lambda a, x: a + x)
    return eig.join(landmarks, "shape_id").select("shape_id", "vid", "to", F.sqrt(F.greatest(total, F.lit(0.0))).alias("distance"))


def shapedna(values: DataFrame, normalize: str = "area") -> DataFrame:
    """ShapeDNA (shape_id, k, value) of eigenvalues (shape_id, k, lambda, area) without the first: times area, over the second eigenvalue (fiedler), or as they are (none)."""
    first = values.where("k = 1").select("shape_id", F.col("lambda").alias("fiedler"))
    rows = values.where("k >= 1")
    if normalize == "area":
        return rows.select("shape_id", "k", (F.col("lambda") * F.col("area")).alias("value"))
    if normalize == "fiedler":
        return rows.join(first, "shape_id").select("shape_id", "k", (F.col("lambda") / F.greatest("fiedler", F.lit(1e-30))).alias("value"))
    if normalize == "none":
        return rows.select("shape_id", "k", F.col("lambda").alias("value"))
    raise ValueError(f"unknown normalisation {normalize}")


def _as_rows(dna: DataFrame) -> DataFrame:
    """(shape_id, v): the values of each shape as one array in order of k."""
    return dna.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("v"))


def wesd(dna: DataFrame, p: float = 2.0, normalize: bool = True) -> DataFrame:
    """Weighted spectral distance (a, b, distance) of all pairs a < b of shapes (shape_id, k, value), over the k that both have; pairs without one are left out."""
    rows = dna.groupBy("shape_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "value")))).alias("v"))
    pairs = all_pairs(rows.select("shape_id", F.map_entries("v").alias("v")), "shape_id", "v")
    common = F.filter(F.transform("p", lambda x: F.struct(x["value"].alias("x"), F.get(F.filter("q", lambda y: y["key"] == x["key"]), F.lit(0))["value"].alias("y"))), lambda e: e["y"].isNotNull())
    term = lambda e: F.pow(F.abs(e["x"] - e["y"]) / F.greatest(e["x"] * e["y"], F.lit(1e-20)), F.lit(p))
    total = F.pow(F.aggregate("c", F.lit(0.0), lambda s, e: s + term(e)), F.lit(1 / p))
    out = pairs.withColumn("c", common).where(F.size("c") > 0).select("a", "b", total.alias("distance"))
    return out.withColumn("distance", F.col("distance") / (1 + F.col("distance"))) if normalize else out


def qc_orthonormality(eig: DataFrame) -> DataFrame:
    """Gram matrix (shape_id, i, j, dot) of the eigenvectors, i <= j; one shuffle of k(k+1)/2 partial sums a task."""
    pairs = eig.select("shape_id", F.posexplode("phi").alias("i", "a"), "phi").select("shape_id", "i", "a", F.posexplode("phi").alias("j", "b")).where("i <= j")
    return pairs.groupBy("shape_id", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
