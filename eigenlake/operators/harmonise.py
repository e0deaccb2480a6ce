"""Site harmonisation with covariates, and the choice of the number of eigenpairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cohort

TINY = 1e-30
#: Covariate columns that a fit takes at most: its normal equations are of this size a feature.
MOST = 64


def without_covariates(rows: DataFrame, covariates: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (subject, site, feature, value) less the covariates' part, and that part (subject, feature, part).

    Slopes are those of least squares with an intercept a site: values and
    covariates are centred within their site, and the normal equations are
    sums a feature, so the solve sees features x names numbers, in batches.
    """
    if len(names) > MOST:
        raise ValueError(f"at most {MOST} covariate columns")
    x = rows.join(covariates.select("subject", *(F.col(c).cast("double").alias(c) for c in names)), "subject").dropna()
    site = x.groupBy("feature", "site").agg(F.avg("value").alias("_y"), *(F.avg(c).alias(f"_{c}") for c in names))
    grand = x.groupBy("feature").agg(*(F.avg(c).alias(f"__{c}") for c in names))
    z = x.join(site, ["feature", "site"])
    y = F.col("value") - F.col("_y")
    c = [F.col(n) - F.col(f"_{n}") for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = z.groupBy("feature").agg(F.array(*(F.sum(c[i] * c[j]) for i, j in pairs)).alias("xx"), F.array(*(F.sum(v * y) for v in c)).alias("xy"))
    size = len(names)

    def solve(batches):
        for b in batches:
            m = np.zeros((len(b), size, size))
            for at, (i, j) in enumerate(pairs):
                m[:, i, j] = m[:, j, i] = [r[at] for r in b["xx"]]
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(m), np.stack(b["xy"].to_numpy())) if len(b) else np.empty((0, size))
            yield b[["feature"]].assign(beta=list(beta))

    kind = rows.schema["feature"].dataType.simpleString()
    slopes = sums.mapInPandas(solve, f"feature {kind}, beta array<double>")
    part = sum(((F.col(n) - F.col(f"__{n}")) * F.get("beta", F.lit(i)) for i, n in enumerate(names)), F.lit(0.0))
    out = x.join(slopes, "feature").join(grand, "feature").withColumn("part", part)
    return out.select("subject", "site", "feature", (F.col("value") - F.col("part")).alias("value")), out.select("subject", "feature", "part")


def combat(rows: DataFrame, covariates: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(subject, site, feature, value, harmonised): ComBat that keeps the part of the covariates (subject, names...); rows without a covariate are left out."""
    names = names or [c for c in covariates.columns if c != "subject"]
    left, part = without_covariates(rows, covariates, names)
    out = cohort.combat(left).join(part, ["subject", "feature"])
    return out.select("subject", "site", "feature", (F.col("value") + F.col("part")).alias("value"), (F.col("harmonised") + F.col("part")).alias("harmonised"))


def bspline_basis(column: str, low: float, high: float, n: int, degree: int = 3) -> list:
    """Expressions of a clamped B-spline basis on [low, high] with 1 % padding, by the Cox-de Boor recursion; values outside go to the nearer end."""
    pad = 0.01 * (high - low) or 1.0
    low, high = low - pad, high + pad
    inner = np.linspace(low, high, n - degree + 1)
    knots = [low] * degree + inner.tolist() + [high] * degree
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))
    have = [F.when((x >= a) & ((x < b) | ((x <= b) & F.lit(b >= high))), 1.0).otherwise(0.0) if b > a else F.lit(0.0) for a, b in zip(knots[:-1], knots[1:], strict=True)]
    for d in range(1, degree + 1):
        new = []
        for i in range(len(have) - 1):
            a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            left = (x - knots[i]) / a * have[i] if a else F.lit(0.0)
            right = (knots[i + d + 1] - x) / b * have[i + 1] if b else F.lit(0.0)
            new.append(left + right)
        have = new
    return have


def combat_gam(rows: DataFrame, covariates: DataFrame, smooth: str, n_splines: int = 5) -> DataFrame:
    """ComBat with a smooth effect of one covariate (a B-spline basis, less its first function) and linear effects of the others."""
    ends = covariates.agg(F.min(smooth).cast("double").alias("lo"), F.max(smooth).cast("double").alias("hi")).first()
    basis = bspline_basis(smooth, ends["lo"] or 0.0, ends["hi"] or 0.0, n_splines)[1:]
    others = [c for c in covariates.columns if c not in ("subject", smooth)]
    names = [f"spline_{i}" for i in range(len(basis))]
    return combat(rows, covariates.where(F.col(smooth).isNotNull()).select("subject", *others, *(b.alias(n) for n, b in zip(names, basis, strict=True))), [*others, *names])


def optimal_k(eig: DataFrame, thresholds: tuple[float, float] = (0.95, 0.99)) -> DataFrame:
    """(shape_id, k_95, k_99, k_gap): first k whose eigenvalues make up 95 and 99 % of the sum, and the k before the largest gap (the first of equals, gaps to nine digits)."""
    lam = eig.groupBy("shape_id").agg(F.first("lam").alias("lam")).select("shape_id", F.posexplode("lam").alias("k", "l"))
    up, every = Window.partitionBy("shape_id").orderBy("k"), Window.partitionBy("shape_id")
    s = lam.withColumn("share", F.sum("l").over(up) / F.nullif(F.sum("l").over(every), F.lit(0.0))).withColumn("g", F.round(F.lead("l").over(up) - F.col("l"), 9))
    first = lambda t: F.min(F.when(F.col("share") >= t, F.col("k") + 1))
    return s.groupBy("shape_id").agg(first(thresholds[0]).alias("k_95"), first(thresholds[1]).alias("k_99"), F.max_by(F.when(F.col("g").isNotNull(), F.col("k") + 1), F.struct("g", (-F.col("k")).alias("m"))).alias("k_gap"))
