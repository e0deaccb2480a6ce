"""Tests with p-values, permutations, representational similarity and vocabulary features over maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eigenlake.functions.special import p_chi2, p_normal, p_student

from . import cohort
from .kernels import per_shape
from .order import all_pairs, midranks, small

TINY = 1e-30
#: Labellings that a task holds at once.
SLICE = 256


def corrected(tests: DataFrame, id_col: str, method: str = "fdr", alpha: float = 0.05) -> DataFrame:
    """Tests (id, p, ...) with p_corrected and significant; a null p counts as 1; methods fdr, bonferroni and none."""
    t = tests.withColumn("p", F.coalesce("p", F.lit(1.0)))
    if method == "none":
        out = t.withColumn("p_corrected", F.col("p"))
    else:
        c = cohort.benjamini_hochberg(t.select(F.col(id_col).alias("id"), "p")).select(F.col("id").alias(id_col), F.col({"fdr": "p_fdr", "bonferroni": "p_bonferroni"}[method]).alias("p_corrected"))
        out = t.join(c, id_col)
    return out.withColumn("significant", F.col("p_corrected") < alpha)


def vertexwise_ttest(maps: DataFrame, a: str, b: str, correction: str = "fdr", alpha: float = 0.05, pooled: bool = False) -> DataFrame:
    """(vid, t, df, cohens_d, hedges_g, p, p_corrected, significant)."""
    return corrected(cohort.ttest(maps, a, b, pooled).withColumn("p", p_student("t", "df")), "vid", correction, alpha)


def vertexwise_mannwhitney(maps: DataFrame, a: str, b: str, correction: str = "fdr", alpha: float = 0.05) -> DataFrame:
    """(vid, u, z, p, p_corrected, significant): normal approximation with correction for ties and continuity."""
    own = maps.where(F.col("grp").isin(a, b))
    u = cohort.mannwhitney(maps, a, b)
    n = own.groupBy("vid").agg(F.count_if(F.col("grp") == a).cast("double").alias("na"), F.count_if(F.col("grp") == b).cast("double").alias("nb"))
    ties = own.groupBy("vid", "value").agg(F.count("*").cast("double").alias("c")).groupBy("vid").agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    total = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (total + 1 - F.col("ties") / F.nullif(total * (total - 1), F.lit(0.0))))
    gap = F.greatest(F.abs(F.col("u") - F.col("na") * F.col("nb") / 2) - 0.5, F.lit(0.0))
    out = u.join(n, "vid").join(ties, "vid").select("vid", "u", (gap / F.nullif(sd, F.lit(0.0))).alias("z"))
    return corrected(out.withColumn("p", p_normal("z")), "vid", correction, alpha)


def vertexwise_correlation(maps: DataFrame, scores: DataFrame, covariates: list[str] | None = None, method: str = "pearson", correction: str = "fdr", alpha: float = 0.05) -> DataFrame:
    """(vid, r, df, p, p_corrected, significant) of maps (subject, vid, value) and scores (subject, score, covariates...).

    With covariates both sides are regressed on them first: the residuals'
    moments follow from sums of products a vertex, so no residual is formed
    unless ranks are asked for.
    """
    covariates = covariates or []
    rows = maps.select("subject", "vid", "value").join(scores.select("subject", F.col("score").cast("double").alias("score"), *(F.col(c).cast("double").alias(c) for c in covariates)), "subject").dropna()
    names = ["value", "score", *covariates]
    if method == "spearman":
        rows = _residuals(rows, covariates) if covariates else rows
        rows = midranks(midranks(rows, "value", "rv", "vid"), "score", "rs", "vid").withColumn("value", F.col("rv")).withColumn("score", F.col("rs")).drop("rv", "rs")
        names = ["value", "score"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    s = rows.groupBy("vid").agg(F.count("*").alias("n"), F.array(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).alias("c"))
    size, lost = len(names), len(covariates)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.zeros((len(b), size, size))
            for at, (i, j) in enumerate(pairs):
                m[:, i, j] = m[:, j, i] = [np.nan if c[at] is None else c[at] for c in b["c"]]
            if size > 2:
                inner = m[:, :2, 2:] @ np.linalg.pinv(np.nan_to_num(m[:, 2:, 2:])) @ m[:, 2:, :2]
                m = m[:, :2, :2] - inner
            with np.errstate(all="ignore"):
                r = np.clip(m[:, 0, 1] / np.sqrt(m[:, 0, 0] * m[:, 1, 1]), -1, 1)
            yield pd.DataFrame({"vid": b["vid"], "r": np.nan_to_num(r), "df": b["n"] - 2.0 - lost})

    out = s.mapInPandas(solve, "vid long, r double, df double")
    t = F.col("r") * F.sqrt(F.col("df") / F.greatest(1 - F.col("r") * F.col("r"), F.lit(TINY)))
    return corrected(out.withColumn("p", p_student(t, F.col("df"))), "vid", correction, alpha)


def _residuals(rows: DataFrame, covariates: list[str]) -> DataFrame:
    def kernel(r):
        x = np.column_stack([np.ones(len(r)), r[covariates].to_numpy(float)])
        y = r[["value", "score"]].to_numpy(float)
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return {"vid": r["shape_id"], "value": left[:, 0], "score": left[:, 1]}

    return per_shape(rows.withColumnRenamed("vid", "shape_id"), kernel, "vid long, value double, score double", order="subject").drop("shape_id")


def _labellings(n: int, n_a: int, first: int, last: int, seed: int) -> np.ndarray:
    """Rows first..last (exclusive) of 0/1 labellings; row 0 is the observed one (n_a ones first), each other is drawn by its own number."""
    out = np.zeros((last - first, n))
    for i in range(first, last):
        at = np.random.default_rng([seed, i]).permutation(n)[:n_a] if i else np.arange(n_a)
        out[i - first, at] = 1
    return out


def permutation_test(maps: DataFrame, a: str, b: str, permutations: int = 5000, seed: int = 0, alpha: float = 0.05, statistic: str = "t") -> DataFrame:
    """(vid, statistic, p, p_max, significant): add-one p of each vertex, and against the largest statistic of all vertices in each permutation.

    Labellings are drawn from the seed alone, so results don't depend on
    partitions.  Vertices are columns of one array a subject order each; a
    task multiplies its vertices with all labellings and returns one maximum a
    labelling, so that what meets is permutations x tasks numbers.  Subjects
    are those of both groups, and each has one value a vertex; vertices that
    lack a subject are left out.
    """
    own = maps.where(F.col("grp").isin(a, b) & F.col("value").isNotNull())
    order = F.array_sort(F.collect_list(F.struct((F.col("grp") != a).alias("second"), "subject", "value")))
    size = own.select("grp", "subject").distinct().groupBy().agg(F.count_if(F.col("grp") == a).alias("na"), F.count("*").alias("n")).first()
    n, n_a = size["n"], size["na"]
    rows = own.groupBy("vid").agg(F.transform(order, lambda s: s["value"]).alias("values")).where(F.size("values") == n)
    if not n_a or n_a == n:
        return rows.limit(0).select("vid", F.lit(0.0).alias("statistic"), F.lit(1.0).alias("p"), F.lit(1.0).alias("p_max"), F.lit(False).alias("significant"))

    def statistics(y: np.ndarray, first: int, last: int) -> np.ndarray:
        l = _labellings(n, n_a, first, last, seed)
        sa, qa = l @ y, l @ (y * y)
        ma, mb = sa / n_a, (y.sum(axis=0) - sa) / (n - n_a)
        if statistic == "mean_diff":
            return ma - mb
        va = (qa - n_a * ma * ma) / max(n_a - 1, 1)
        vb = ((y * y).sum(axis=0) - qa - (n - n_a) * mb * mb) / max(n - n_a - 1, 1)
        with np.errstate(all="ignore"):
            return np.nan_to_num((ma - mb) / np.sqrt(np.maximum(va / n_a + vb / (n - n_a), 0)), posinf=0, neginf=0)

    def chunks(batches):
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                yield part["vid"], np.stack(part["values"].to_numpy()).astype(float).T

    slices = [(lo, min(lo + SLICE, permutations + 1)) for lo in range(0, permutations + 1, SLICE)]

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.zeros(permutations + 1)
        for _, y in chunks(batches):
            for lo, hi in slices:
                top[lo:hi] = np.maximum(top[lo:hi], np.abs(statistics(y, lo, hi)).max(axis=1))
        yield pd.DataFrame({"permutation": np.arange(permutations + 1), "top": top})

    tops = rows.mapInPandas(largest, "permutation int, top double").groupBy("permutation").agg(F.max("top").alias("top"))
    null = np.sort(np.array([r.top for r in tops.where("permutation > 0").collect()]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vid, y in chunks(batches):
            own = statistics(y, 0, 1)[0]
            seen, n_as_large = np.abs(own), np.zeros(y.shape[1])
            for lo, hi in slices:
                n_as_large += (np.abs(statistics(y, lo, hi)) >= seen - 1e-12).sum(axis=0)
            max_p = (1 + len(null) - np.searchsorted(null, seen - 1e-12)) / (permutations + 1)
            yield pd.DataFrame({"vid": vid, "statistic": own, "p": n_as_large / (permutations + 1), "p_max": max_p, "significant": max_p < alpha})

    return rows.mapInPandas(judge, "vid long, statistic double, p double, p_max double, significant boolean")


def tfce(field: DataFrame, edges: DataFrame, e: float = 0.5, h: float = 2.0, steps: int = 100) -> DataFrame:
    """(shape_id, vid, tfce): threshold-free cluster enhancement of a field (shape_id, vid, value) over edges (shape_id, u, v); positive and negative parts apart, the sign is kept."""
    from .kernels import per_pair

    def kernel(f, g):
        ids, value = f["vid"].to_numpy(), f["value"].to_numpy(float)
        u, v, out = np.searchsorted(ids, g["u"]), np.searchsorted(ids, g["v"]), np.zeros(len(ids))
        for sign in (1.0, -1.0):
            x = np.maximum(sign * value, 0)
            dh = x.max(initial=0) / steps
            for level in (dh * np.arange(1, steps + 1) if dh > 0 else ()):
                on = x >= level - 1e-12
                label = np.where(on, np.arange(len(ids)), -1)
                inner = on[u] & on[v]
                a, b = u[inner], v[inner]
                while True:  # smallest label along edges, with pointer jumping
                    low = np.minimum(label[a], label[b])
                    new = label.copy()
                    np.minimum.at(new, a, low)
                    np.minimum.at(new, b, low)
                    new[on] = new[new[on]]
                    if (new == label).all():
                        break
                    label = new
                extent = np.bincount(label[on], minlength=len(ids))[label[on]]
                out[on] += sign * extent**e * level**h * dh
        return {"vid": ids, "tfce": out}

    return per_pair(field.select("shape_id", "vid", "value"), edges.select("shape_id", "u", "v"), kernel, "vid long, tfce double", ("vid", "u"))


def asymmetry(pairs: DataFrame) -> DataFrame:
    """(feature, w_plus, n, z, p): Wilcoxon signed ranks of left - right, zeros left out, ties by midranks, normal approximation."""
    d = pairs.withColumn("d", F.col("left") - F.col("right")).where("d <> 0").withColumn("a", F.abs("d"))
    r = midranks(d, "a", "r", "feature")
    ties = r.groupBy("feature", "a").agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = r.groupBy("feature").agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.count("*").alias("n")).join(ties, "feature")
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("feature", "w_plus", "n", ((F.col("w_plus") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("z")).withColumn("p", p_normal("z"))


def surprise(subject: DataFrame, normative: DataFrame) -> DataFrame:
    """(vid, z): value against the normative mean and std (vid, mean, std)."""
    return subject.join(normative, "vid").select("vid", ((F.col("value") - F.col("mean")) / (F.col("std") + TINY)).alias("z"))


def percentile_score(subject: DataFrame, normative: DataFrame) -> DataFrame:
    """(vid, percentile): share of the normative values (vid, value) below, equal ones by their middle rank."""
    x = subject.select("vid", F.col("value").alias("x"))
    below, upto = F.count_if(F.col("value") < F.col("x")), F.count_if(F.col("value") <= F.col("x"))
    n = F.count("*")
    middle = F.when(upto > below, below + upto + 1).otherwise(below + upto)
    return normative.join(x, "vid").groupBy("vid", "x").agg((50.0 * middle / n).alias("percentile")).select("vid", "percentile")


def rdm(features: DataFrame, metric: str = "correlation") -> DataFrame:
    """(a, b, d) for a < b of items (id, f array): correlation, euclidean or cosine distance.

    Items are conditions or shapes, not vertices: all pairs are the result.
    """
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    f = F.col("f")
    if metric == "correlation":
        mean = F.aggregate(f, F.lit(0.0), lambda s, v: s + v) / F.size(f)
        f = F.transform(f, lambda v: v - mean)
    pairs = all_pairs(features.select("id", F.struct(f.alias("f"), F.sqrt(dot(f, f)).alias("n")).alias("v")), "id", "v")
    if metric == "euclidean":
        d = F.sqrt(F.aggregate(F.zip_with("p.f", "q.f", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    else:
        d = 1 - dot(F.col("p.f"), F.col("q.f")) / F.greatest(F.col("p.n") * F.col("q.n"), F.lit(TINY))
    return pairs.select("a", "b", d.alias("d"))


def rsa_compare(rdm_a: DataFrame, rdm_b: DataFrame, method: str = "spearman") -> DataFrame:
    """(r, n): correlation of two matrices' upper triangles (a, b, d)."""
    rows = rdm_a.select("a", "b", F.col("d").alias("x")).join(rdm_b.select("a", "b", F.col("d").alias("y")), ["a", "b"])
    if method == "spearman":
        rows = midranks(midranks(rows, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    return rows.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def mantel_test(rdm_a: DataFrame, rdm_b: DataFrame, permutations: int = 5000, method: str = "spearman", seed: int = 0) -> DataFrame:
    """(r, p): items of the second matrix are relabelled; add-one p of |r|.

    Permutations are rows of a distributed table; each task gets both
    triangles, so this is for matrices of shapes or parcels, up to ``LIMIT``
    items.
    """
    rows = rdm_a.select("a", "b", F.col("d").alias("x")).join(rdm_b.select("a", "b", F.col("d").alias("y")), ["a", "b"])
    if method == "spearman":
        rows = midranks(midranks(rows, "x", "rx"), "y", "ry").select("a", "b", F.col("rx").alias("x"), F.col("ry").alias("y"))
    items = rows.select(F.explode(F.array("a", "b")).alias("i")).distinct()
    if items.count() > LIMIT:
        raise ValueError(f"mantel_test holds matrices of up to {LIMIT} items")
    t = rows.toPandas()
    ids = np.unique(np.concatenate([t["a"], t["b"]]))
    i, j, n = np.searchsorted(ids, t["a"]), np.searchsorted(ids, t["b"]), len(ids)
    y = np.zeros((n, n))
    y[i, j] = y[j, i] = t["y"]
    x = t["x"].to_numpy(float) - t["x"].mean()

    def correlate(p: np.ndarray) -> float:
        z = y[p[i], p[j]]
        z = z - z.mean()
        return float(x @ z / max(np.sqrt((x @ x) * (z @ z)), TINY))

    seen = correlate(np.arange(n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"hit": [abs(correlate(np.random.default_rng([seed, int(s)]).permutation(n))) >= abs(seen) - 1e-12 for s in b["id"]]})

    hits = rows.sparkSession.range(permutations).mapInPandas(run, "hit boolean")
    return hits.agg(F.lit(seen).alias("r"), ((1 + F.count_if("hit")) / (permutations + 1)).alias("p"))


#: Items of a matrix whose permutations are tested; its triangle goes to every task.
LIMIT = 3000


def non_inferiority(metrics: DataFrame, margin: float = 0.05, paired: bool = True) -> DataFrame:
    """(difference, se, df, t, p, lower) of metrics (new, ref): one-sided test that new is no more than margin below ref; lower is the 97.5 % bound by the normal quantile."""
    if paired:
        d = F.col("new") - F.col("ref")
        s = metrics.agg(F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), (F.count(d) - 1).cast("double").alias("df"))
    else:
        va, vb = F.var_samp("new") / F.count("new"), F.var_samp("ref") / F.count("ref")
        df = (va + vb) * (va + vb) / (va * va / (F.count("new") - 1) + vb * vb / (F.count("ref") - 1))
        s = metrics.agg((F.avg("new") - F.avg("ref")).alias("difference"), F.sqrt(va + vb).alias("se"), df.alias("df"))
    t = (F.col("difference") + margin) / (F.col("se") + TINY)
    two = p_student("t", "df")
    return s.withColumn("t", t).withColumn("p", F.when(F.col("t") > 0, two / 2).otherwise(1 - two / 2)).withColumn("lower", F.col("difference") - 1.959963984540054 * F.col("se"))


def equivalence_tost(metrics: DataFrame, margin: float = 0.05) -> DataFrame:
    """(difference, t_lower, t_upper, p): two one-sided paired tests; p is the larger."""
    d = F.col("new") - F.col("ref")
    s = metrics.agg(F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), (F.count(d) - 1).cast("double").alias("df"))
    s = s.withColumn("t_lower", (F.col("difference") + margin) / (F.col("se") + TINY)).withColumn("t_upper", (F.col("difference") - margin) / (F.col("se") + TINY))
    low, high = p_student("t_lower", "df"), p_student("t_upper", "df")
    return s.select("difference", "t_lower", "t_upper", F.greatest(F.when(F.col("t_lower") > 0, low / 2).otherwise(1 - low / 2), F.when(F.col("t_upper") < 0, high / 2).otherwise(1 - high / 2)).alias("p"))


def bag_of_words(descriptors: DataFrame, codebook: DataFrame, sigma: float | None = None) -> DataFrame:
    """(shape_id, word, share) of descriptors (shape_id, vid, f array) over a codebook (word, c array): the nearest word (the smaller of equals), or Gaussian weights for a sigma; shares of a shape sum to 1."""
    d2 = F.aggregate(F.zip_with("f", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    far = descriptors.crossJoin(small(codebook)).withColumn("d2", d2)  # the codebook has some dozens of words
    if sigma is None:
        hit = far.groupBy("shape_id", "vid").agg(F.min(F.struct("d2", "word")).alias("m")).select("shape_id", F.col("m.word").alias("word"), F.lit(1.0).alias("w"))
    else:
        hit = far.select("shape_id", "word", F.exp(-F.col("d2") / (2 * sigma * sigma)).alias("w"))
    s = hit.groupBy("shape_id", "word").agg(F.sum("w").alias("w"))
    return s.select("shape_id", "word", (F.col("w") / F.sum("w").over(Window.partitionBy("shape_id"))).alias("share"))


def fisher_vector(descriptors: DataFrame, weights: list[float], means: list[list[float]], variances: list[list[float]]) -> DataFrame:
    """(shape_id, fv array): gradients of a diagonal Gaussian mixture by means, then variances; signed roots, of length 1."""
    w, m, v = np.array(weights), np.array(means), np.maximum(np.array(variances), 1e-12)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shape, rows in b.groupby("shape_id", sort=False):
                x = np.stack(rows["f"].to_numpy()).astype(float)
                u = (x[:, None] - m) / np.sqrt(v)
                log = np.log(w) - 0.5 * (u * u + np.log(v)).sum(axis=2)
                q = np.exp(log - log.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                g = np.concatenate([np.einsum("nk,nkd->kd", q, u).ravel(), np.einsum("nk,nkd->kd", q, u * u - 1).ravel()])
                yield pd.DataFrame({"shape_id": [shape] * len(g), "at": np.arange(len(g)), "g": g, "n": len(x)})

    kind = descriptors.schema["shape_id"].dataType.simpleString()
    s = descriptors.select("shape_id", "f").mapInPandas(partial, f"shape_id {kind}, at int, g double, n long").groupBy("shape_id", "at").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    scale = F.element_at(F.array(*(F.lit(float(np.sqrt(x))) for x in np.concatenate([np.repeat(w, m.shape[1]), np.repeat(2 * w, m.shape[1])]))), F.col("at") + 1)
    g = F.col("g") / F.col("n") / scale
    s = s.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (F.signum(g) * F.sqrt(F.abs(g))).alias("g")))), lambda x: x["g"]).alias("fv"))
    norm = F.sqrt(F.aggregate("fv", F.lit(0.0), lambda a, x: a + x * x))
    return s.select("shape_id", F.transform("fv", lambda x: x / F.greatest(norm, F.lit(TINY))).alias("fv"))


def kernel_mean_embedding(descriptors: DataFrame, sigma: float, landmarks: int = 100, seed: int = 0) -> DataFrame:
    """(shape_id, at, value): mean of random Fourier features of a Gaussian kernel; frequencies come from the seed alone."""
    width = descriptors.select(F.max(F.size("f"))).first()[0] or 0
    draw = np.random.default_rng(seed)
    w, phase = draw.standard_normal((width, landmarks)) / sigma, draw.uniform(0, 2 * np.pi, landmarks)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shape, rows in b.groupby("shape_id", sort=False):
                z = np.sqrt(2 / landmarks) * np.cos(np.stack(rows["f"].to_numpy()).astype(float) @ w + phase)
                yield pd.DataFrame({"shape_id": [shape] * landmarks, "at": np.arange(landmarks), "s": z.sum(axis=0), "n": len(z)})

    kind = descriptors.schema["shape_id"].dataType.simpleString()
    s = descriptors.select("shape_id", "f").mapInPandas(partial, f"shape_id {kind}, at int, s double, n long")
    return s.groupBy("shape_id", "at").agg((F.sum("s") / F.sum("n")).alias("value"))


def kruskal_p(rows: DataFrame, group: str, value: str, *by: str) -> DataFrame:
    """Kruskal-Wallis with p and eta squared."""
    k = cohort.kruskal(rows, group, value, *by)
    return k.withColumn("p", p_chi2(F.col("h"), (F.col("groups") - 1).cast("double"))).withColumn("eta2", F.col("h") / F.nullif(F.col("n") - 1, F.lit(0)))
