"""Bayesian models by Gibbs sampling, one chain a task; posteriors are DataFrames of draws or their summaries.

The data reach a chain as sums (regressions: products of columns) or, where
the model needs each value, as rows up to ``LIMIT``; more is an error, never
a sample.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a model which needs each value takes.
LIMIT = 200_000


def _rows(df: DataFrame) -> pd.DataFrame:
    n = df.count()
    if n > LIMIT:
        raise ValueError(f"this model takes up to {LIMIT} rows, not {n}")
    return df.toPandas()


def _chains(df: DataFrame, chain: Callable[[np.random.Generator], pd.DataFrame], chains: int, seed: int, columns: str) -> DataFrame:
    """Draws of all chains: (chain, draw, parameter, value) rows as ``columns`` says."""
    session = df.sparkSession

    def run(batches):
        for b in batches:
            for c in b["id"]:
                out = chain(np.random.default_rng([seed, int(c)]))
                out["chain"] = int(c)
                yield out

    return session.range(0, chains, 1, chains).mapInPandas(run, columns)


def summary(draws: DataFrame) -> DataFrame:
    """(parameter, mean, sd, low, high, r_hat): 94 % interval by quantiles and the potential scale reduction of chains."""
    per = draws.groupBy("parameter", "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    r = per.groupBy("parameter").agg(F.avg("v").alias("w"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("b"), F.avg("n").alias("n"))
    r = r.select("parameter", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.nullif(F.col("w"), F.lit(0.0))).alias("r_hat"))
    s = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.03).alias("low"), F.percentile("value", 0.97).alias("high"))
    return s.join(r, "parameter")


DRAWS = "chain int, draw int, parameter string, value double"


def _long(names: list[str], table: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"draw": np.repeat(np.arange(len(table)), len(names)), "parameter": np.tile(names, len(table)), "value": table.ravel()})[["draw", "parameter", "value"]]


def horseshoe(rows: DataFrame, draws: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42) -> DataFrame:
    """Draws of beta_0.., alpha and sigma of y on columns x (x array, y) with horseshoe shrinkage, by inverse-gamma mixtures; x and y enter as sums of products only."""
    x = rows.select("x", F.col("y").cast("double").alias("y")).dropna()
    p = x.select(F.max(F.size("x"))).first()[0] or 0
    cols = [F.get("x", F.lit(i)) for i in range(p)] + [F.col("y")]
    sums = x.agg(F.count("*"), *(F.avg(c) for c in cols), *(F.covar_pop(cols[i], cols[j]) for i in range(p + 1) for j in range(i, p + 1))).first()
    n, mean, cov = sums[0], np.array(sums[1 : p + 2], float), np.zeros((p + 1, p + 1))
    cov[np.triu_indices(p + 1)] = sums[p + 2 :]
    cov = (cov + np.triu(cov, 1).T) * n
    xx, xy, yy = cov[:p, :p], cov[:p, p], cov[p, p]

    def chain(draw):
        lam2, nu, tau2, xi, s2 = np.ones(p), np.ones(p), 1.0, 1.0, max(yy / n, 1e-12)
        out = np.empty((draws, p + 2))
        inverse_gamma = lambda a, b: 1 / draw.gamma(a, 1 / b)
        for t in range(-tune, draws):
            a = np.linalg.cholesky(xx + np.diag(1 / np.maximum(tau2 * lam2, 1e-12)))
            beta = np.linalg.solve(a.T, np.linalg.solve(a, xy) + np.sqrt(s2) * draw.standard_normal(p))
            fit = max(yy - 2 * beta @ xy + beta @ xx @ beta, 1e-12)
            s2 = inverse_gamma((n - 1 + p) / 2, (fit + (beta**2 / (tau2 * lam2)).sum()) / 2)
            lam2 = np.maximum(inverse_gamma(1.0, 1 / nu + beta**2 / (2 * tau2 * s2)), 1e-12)
            nu = inverse_gamma(1.0, 1 + 1 / lam2)
            tau2 = max(inverse_gamma((p + 1) / 2, 1 / xi + (beta**2 / lam2).sum() / (2 * s2)), 1e-12)
            xi = inverse_gamma(1.0, 1 + 1 / tau2)
            if t >= 0:
                out[t] = [*beta, mean[p] - beta @ mean[:p] + np.sqrt(s2 / n) * draw.standard_normal(), np.sqrt(s2)]
        return _long([f"beta_{i}" for i in range(p)] + ["alpha", "sigma"], out)

    return _chains(rows, chain, chains, seed, DRAWS)


def best(rows: DataFrame, a: str, b: str, draws: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42) -> DataFrame:
    """Draws of mu_a, mu_b, sigma_a, sigma_b, nu and effect of two groups (grp, value) with Student noise; nu - 1 is exponential with mean 29."""
    data = _rows(rows.where(F.col("grp").isin(a, b) & F.col("value").isNotNull()).select("grp", F.col("value").cast("double").alias("value")))
    groups = [data.loc[data["grp"] == g, "value"].to_numpy() for g in (a, b)]
    if min(map(len, groups)) < 2:
        raise ValueError("each group needs two values at least")
    every = np.concatenate(groups)
    centre, wide = every.mean(), max(every.std(), 1e-12)
    grid = 1 + np.geomspace(0.5, 200, 200)

    def chain(draw):
        from math import lgamma

        constant = np.array([g / 2 * np.log(g / 2) - lgamma(g / 2) for g in grid])
        prior = -(grid - 1) / 29 + np.log(grid)  # points are log-spaced
        mu, s2, nu, out = [g.mean() for g in groups], [max(g.var(), 1e-12) for g in groups], 30.0, np.empty((draws, 6))
        for t in range(-tune, draws):
            log_w = sum_w = 0.0
            for i, g in enumerate(groups):
                w = draw.gamma((nu + 1) / 2, 2 / (nu + (g - mu[i]) ** 2 / s2[i]))
                precision = w.sum() / s2[i] + 1 / (100 * wide) ** 2
                mu[i] = ((w * g).sum() / s2[i] + centre / (100 * wide) ** 2) / precision + draw.standard_normal() / np.sqrt(precision)
                s2[i] = 1 / draw.gamma(len(g) / 2, 2 / max((w * (g - mu[i]) ** 2).sum(), 1e-300))
                log_w, sum_w = log_w + np.log(w).sum(), sum_w + w.sum()
            log = len(every) * constant + (grid / 2 - 1) * log_w - grid / 2 * sum_w + prior
            weight = np.exp(log - log.max())
            nu = float(draw.choice(grid, p=weight / weight.sum()))
            if t >= 0:
                out[t] = [*mu, *np.sqrt(s2), nu, (mu[0] - mu[1]) / np.sqrt((s2[0] + s2[1]) / 2)]
        return _long(["mu_a", "mu_b", "sigma_a", "sigma_b", "nu", "effect"], out)

    return _chains(rows, chain, chains, seed, DRAWS)


def rope(draws: DataFrame, parameter: str = "effect", low: float = -0.1, high: float = 0.1) -> DataFrame:
    """(below, within, above): shares of the draws by a region of practical equivalence."""
    v = F.col("value")
    share = lambda c: F.avg(c.cast("double"))
    return draws.where(F.col("parameter") == parameter).agg(share(v < low).alias("below"), share((v >= low) & (v <= high)).alias("within"), share(v > high).alias("above"))


def site_intercepts(rows: DataFrame, draws: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42) -> DataFrame:
    """Draws of alpha, sigma, sigma_site and u_<site> of values (site, value): a random intercept a site; each site enters as count, mean and variance."""
    s = _rows(rows.groupBy("site").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).where("n > 0").orderBy("site"))
    n, m, v = (s[c].to_numpy(float) for c in ("n", "m", "v"))

    def chain(draw):
        alpha, s2, t2, out = m.mean(), max(v.mean(), 1e-6), max(m.var(), 1e-6), np.empty((draws, 3 + len(m)))
        for t in range(-tune, draws):
            precision = n / s2 + 1 / t2
            u = n * (m - alpha) / s2 / precision + draw.standard_normal(len(m)) / np.sqrt(precision)
            alpha = (n * (m - u)).sum() / n.sum() + np.sqrt(s2 / n.sum()) * draw.standard_normal()
            s2 = 1 / draw.gamma(n.sum() / 2, 2 / max((n * (v + (m - alpha - u) ** 2)).sum(), 1e-300))
            t2 = 1 / draw.gamma((len(m) + 1) / 2, 2 / max((u**2).sum() + 1e-3, 1e-300))
            if t >= 0:
                out[t] = [alpha, np.sqrt(s2), np.sqrt(t2), *u]
        return _long(["alpha", "sigma", "sigma_site"] + [f"u_{x}" for x in s["site"]], out)

    return _chains(rows, chain, chains, seed, DRAWS)


#: Distinct ages of a Gaussian process: the solve is cubic in them.
AGES = 2000


def gp_normative(rows: DataFrame, kernel: str = "matern52") -> DataFrame:
    """(age, mean, sd): latent normative curve at each age of (age, value), by the best marginal likelihood over a grid of length scales and noise shares.

    Values of one age enter as count, mean and variance, which is exact for
    this model; more than ``AGES`` distinct ages are an error.
    """
    per = rows.where("age is not null and value is not null").groupBy(F.col("age").cast("double").alias("age")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).orderBy("age")
    if per.count() > AGES:
        raise ValueError(f"at most {AGES} distinct ages")
    s = per.toPandas()
    if s.empty:
        return rows.sparkSession.createDataFrame([], "age double, mean double, sd double")
    age, n, m, v = (s[c].to_numpy(float) for c in ("age", "n", "m", "v"))
    centre = (n * m).sum() / n.sum()
    total = max((n * (v + (m - centre) ** 2)).sum() / n.sum(), 1e-12)
    y = (m - centre) / np.sqrt(total)
    gap = np.abs(age[:, None] - age)
    shape = {"matern32": lambda r: (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r), "matern52": lambda r: (1 + np.sqrt(5) * r + 5 * r * r / 3) * np.exp(-np.sqrt(5) * r), "rbf": lambda r: np.exp(-r * r / 2)}[kernel]
    best_of, span = None, max(gap.max(), 1e-9)
    for length in span * np.geomspace(0.05, 2, 8):
        k = shape(gap / length)
        for noise in np.geomspace(0.01, 0.99, 10):
            a = (1 - noise) * k + np.diag(noise / n) + 1e-9 * np.eye(len(n))
            c = np.linalg.cholesky(a)
            half = np.linalg.solve(c, y)
            inner = (n * v).sum() / total / noise + (n - 1).sum() * np.log(noise)
            fit = -0.5 * (half @ half) - np.log(np.diag(c)).sum() - 0.5 * inner
            if best_of is None or fit > best_of[0]:
                best_of = fit, (1 - noise) * k, c, half
    _, k, c, half = best_of
    w = np.linalg.solve(c, k)
    mean, var = w.T @ half, np.maximum(np.diag(k) - np.square(w).sum(axis=0), 0)
    out = np.column_stack([age, centre + mean * np.sqrt(total), np.sqrt(var * total)])
    return rows.sparkSession.createDataFrame(out.tolist(), "age double, mean double, sd double")


def deviation(rows: DataFrame, curve: DataFrame) -> DataFrame:
    """(id, z): values (id, age, value) against a normative curve (age, mean, sd)."""
    return rows.join(curve, "age").select("id", ((F.col("value") - F.col("mean")) / (F.col("sd") + 1e-30)).alias("z"))


def predict(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, mean, sd) of the linear predictor alpha + sum of beta_j x_j over the draws, rows (id, x array); draws are the sampler's and are sent to the rows."""
    beta = draws.where(F.col("parameter").startswith("beta_")).select("chain", "draw", F.substring_index("parameter", "_", -1).cast("int").alias("j"), "value")
    wide = beta.groupBy("chain", "draw").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda s: s["value"]).alias("b"))
    wide = wide.join(draws.where("parameter = 'alpha'").select("chain", "draw", F.col("value").alias("a")), ["chain", "draw"])
    moments = wide.select(F.struct("a", "b").alias("d")).agg(F.collect_list("d").alias("draws"))  # as many as were drawn
    at = rows.crossJoin(F.broadcast(moments))
    value = F.transform("draws", lambda d: d["a"] + F.aggregate(F.zip_with(d["b"], "x", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t))
    total = lambda f: F.aggregate("y", F.lit(0.0), f)
    at = at.select("id", value.alias("y"))
    n = F.size("y")
    at = at.withColumn("mean", total(lambda s, t: s + t) / n)
    return at.select("id", "mean", F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, t: s + (t - F.col("mean")) * (t - F.col("mean"))) / F.greatest(n - 1, F.lit(1))).alias("sd"))


def waic(log_likelihood: DataFrame) -> DataFrame:
    """(elpd, p_waic, waic, n) from log-likelihoods (obs, draw, ll) of each observation under each draw; the mean of the likelihoods is formed beside the largest."""
    top = log_likelihood.groupBy("obs").agg(F.max("ll").alias("top"), F.var_samp("ll").alias("v"))
    mean = log_likelihood.join(top, "obs").groupBy("obs", "top", "v").agg(F.avg(F.exp(F.col("ll") - F.col("top"))).alias("m"))
    out = mean.agg(F.sum(F.col("top") + F.log("m")).alias("lppd"), F.sum("v").alias("p_waic"), F.count("*").alias("n"))
    return out.select((F.col("lppd") - F.col("p_waic")).alias("elpd"), "p_waic", (-2 * (F.col("lppd") - F.col("p_waic"))).alias("waic"), "n")


def importance(draws: DataFrame) -> DataFrame:
    """(feature, importance): the mean size of each beta_j over the draws."""
    beta = draws.where(F.col("parameter").startswith("beta_"))
    return beta.groupBy(F.substring_index("parameter", "_", -1).cast("int").alias("feature")).agg(F.avg(F.abs("value")).alias("importance"))


def edge_differences(edges: DataFrame, a: str, b: str, draws: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42) -> DataFrame:
    """Draws of mu, tau and diff_i_j from group means of edges (subject, grp, i, j, w): the differences b - a are normal about mu.

    The groups enter as means, variances and numbers of each edge, so a chain
    holds edges and not subjects, up to ``LIMIT`` of them.
    """
    of = lambda f, g: f(F.when(F.col("grp") == g, F.col("w")))
    s = edges.groupBy("i", "j").agg((of(F.avg, b) - of(F.avg, a)).alias("d"), (of(F.var_samp, a) / of(F.count, a) + of(F.var_samp, b) / of(F.count, b)).alias("v")).where("d is not null and v is not null")
    t = _rows(s).sort_values(["i", "j"])
    d, v = t["d"].to_numpy(float), np.maximum(t["v"].to_numpy(float), 1e-12)
    names = ["mu", "tau", *(f"diff_{i}_{j}" for i, j in zip(t["i"], t["j"], strict=True))]

    def chain(rng: np.random.Generator) -> pd.DataFrame:
        mu, tau2, out = float(d.mean()), float(d.var()) + 1e-6, []
        for step in range(tune + draws):
            precision = 1 / v + 1 / tau2
            delta = (d / v + mu / tau2) / precision + rng.standard_normal(len(d)) / np.sqrt(precision)
            mu = float(delta.mean() + rng.standard_normal() * np.sqrt(tau2 / len(d)))
            tau2 = (1e-6 + 0.5 * np.square(delta - mu).sum()) / rng.gamma(1e-3 + len(d) / 2)
            if step >= tune:
                out.append(np.concatenate([[mu, np.sqrt(tau2)], delta]))
        return _long(names, np.array(out))

    return _chains(edges, chain, chains, seed, DRAWS)


def spatial_effect(maps: DataFrame, edges: DataFrame, a: str, b: str, smooth: float = 1.0, draws: int = 1000, tune: int = 500, chains: int = 4, seed: int = 42) -> DataFrame:
    """Draws of tau and effect_vid: the difference b - a of maps (subject, grp, vid, value), smooth along edges (u, v).

    Effects have the precision (Laplacian + ``smooth`` / 1000) / tau^2; the groups
    enter as means and numbers, so a chain holds vertices, up to 3,000 of
    them, as it solves a dense system a draw.
    """
    of = lambda f, g: f(F.when(F.col("grp") == g, F.col("value")))
    s = maps.groupBy("vid").agg((of(F.avg, b) - of(F.avg, a)).alias("d"), (of(F.var_samp, a) / of(F.count, a) + of(F.var_samp, b) / of(F.count, b)).alias("v")).where("d is not null and v is not null")
    t, e = _rows(s).sort_values("vid"), _rows(edges.select("u", "v"))
    if len(t) > 3000:
        raise ValueError(f"this model takes up to 3000 vertices, not {len(t)}")
    ids, d, v = t["vid"].to_numpy(), t["d"].to_numpy(float), np.maximum(t["v"].to_numpy(float), 1e-12)
    keep = e["u"].isin(ids) & e["v"].isin(ids)
    i, j = np.searchsorted(ids, e["u"][keep]), np.searchsorted(ids, e["v"][keep])
    lap = np.zeros((len(ids), len(ids)))
    lap[i, j] = lap[j, i] = -1
    np.fill_diagonal(lap, -lap.sum(axis=1) + smooth / 1000)
    names = ["tau", *(f"effect_{x}" for x in ids)]

    def chain(rng: np.random.Generator) -> pd.DataFrame:
        tau2, out = float(d.var()) + 1e-6, []
        for step in range(tune + draws):
            root = np.linalg.cholesky(lap / tau2 + np.diag(1 / v))
            mean = np.linalg.solve(root.T, np.linalg.solve(root, d / v))
            effect = mean + np.linalg.solve(root.T, rng.standard_normal(len(d)))
            tau2 = (1e-6 + 0.5 * effect @ lap @ effect) / rng.gamma(1e-3 + len(d) / 2)
            if step >= tune:
                out.append(np.concatenate([[np.sqrt(tau2)], effect]))
        return _long(names, np.array(out))

    return _chains(maps, chain, chains, seed, DRAWS)


def effects(draws: DataFrame, prefix: str = "effect_") -> DataFrame:
    """(name, mean): posterior means of the parameters with this prefix, by the rest of their names."""
    return draws.where(F.col("parameter").startswith(prefix)).groupBy(F.substring("parameter", len(prefix) + 1, 1 << 20).alias("name")).agg(F.avg("value").alias("mean"))
