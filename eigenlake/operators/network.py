"""Connectomes as edge lists (i, j, w), every ordered pair at most once, and communities (i, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-30


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, weights of the two added, loops left out."""
    e = edges.where("i <> j").select("i", "j", "w")
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def _placed(edges: DataFrame, communities: DataFrame) -> DataFrame:
    a, b = communities.select("i", F.col("c").alias("ci")), communities.select(F.col("i").alias("j"), F.col("c").alias("cj"))
    return edges.join(a, "i").join(b, "j")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(q): sum over communities of the inner share less the squared share of strength, for symmetric edges."""
    e = _placed(symmetric(edges), communities)
    per = e.groupBy(F.col("ci").alias("c")).agg(F.sum("w").alias("strength"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("inner"))
    s = per.agg(F.sum("strength").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("strength") * F.col("strength")).alias("sq"))
    return s.select((F.col("inner") / F.col("m2") - F.col("sq") / (F.col("m2") * F.col("m2"))).alias("q"))


def participation(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(i, strength, participation): one less the squared shares of a node's strength by community."""
    e = _placed(symmetric(edges), communities).groupBy("i", "cj").agg(F.sum("w").alias("s"))
    return e.groupBy("i").agg(F.sum("s").alias("strength"), (1 - F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("participation"))


def intra_inter(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(intra, inter, ratio) of mean weights within and between communities."""
    e = _placed(symmetric(edges), communities)
    same = F.col("ci") == F.col("cj")
    return e.agg(F.avg(F.when(same, F.col("w"))).alias("intra"), F.avg(F.when(~same, F.col("w"))).alias("inter")).withColumn("ratio", F.col("intra") / (F.col("inter") + TINY))


def block_means(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(ci, cj, w, n): mean weight of each pair of networks over the upper triangle, ci <= cj."""
    e = _placed(symmetric(edges), communities).where("i < j")
    return e.groupBy(F.least("ci", "cj").alias("ci"), F.greatest("ci", "cj").alias("cj")).agg(F.avg("w").alias("w"), F.count("*").alias("n"))
