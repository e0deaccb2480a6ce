"""Distances between the distributions of a value in two groups (g, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running


def divergences(rows: DataFrame, a, b, bins: int = 50) -> DataFrame:
    """(kl, js): divergence of histograms over the shared range, each share raised by 1e-10; js is the mean of both directions."""
    rows = rows.where(F.col("g").isin(a, b))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    counts = rows.crossJoin(F.broadcast(ends)).select("g", F.coalesce(place, F.lit(0)).alias("bin")).groupBy("bin").agg(F.count_if(F.col("g") == a).alias("a"), F.count_if(F.col("g") == b).alias("b"))
    every = rows.sparkSession.range(bins).join(counts, F.col("id") == F.col("bin"), "left").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = every.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    norm = 1 + bins * 1e-10
    p, q = ((F.col(c) / F.col(n) + 1e-10) / norm for c, n in (("a", "na"), ("b", "nb")))
    s = every.crossJoin(F.broadcast(total)).select(p.alias("p"), q.alias("q")).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), F.sum(F.col("q") * F.log(F.col("q") / F.col("p"))).alias("lk"))
    return s.select("kl", ((F.col("kl") + F.col("lk")) / 2).alias("js"))


def _steps(rows: DataFrame, a, b) -> DataFrame:
    """Each value with both distribution functions there and the gap to the next value; no task sees all values."""
    s = rows.where(F.col("g").isin(a, b)).groupBy("x").agg(F.count_if(F.col("g") == a).alias("a"), F.count_if(F.col("g") == b).alias("b"))
    return running(s, "x", "a", "b").select("x", (F.col("a_upto") / F.col("a_all")).alias("fa"), (F.col("b_upto") / F.col("b_all")).alias("fb"), (F.col("next") - F.col("x")).alias("gap"))


def wasserstein_1d(rows: DataFrame, a, b) -> DataFrame:
    """(distance): the integral of |F_a - F_b|."""
    return _steps(rows, a, b).agg(F.sum(F.abs(F.col("fa") - F.col("fb")) * F.col("gap")).alias("distance"))


def energy_1d(rows: DataFrame, a, b) -> DataFrame:
    """(distance): 2 E|a-b| - E|a-a'| - E|b-b'|, as twice the integral of (F_a - F_b)^2, so no pairs are formed."""
    d = F.col("fa") - F.col("fb")
    return _steps(rows, a, b).agg((2 * F.sum(d * d * F.col("gap"))).alias("distance"))
