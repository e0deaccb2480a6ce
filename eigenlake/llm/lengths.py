"""Token counts of a corpus under any context limit, from an exact length histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import cut

#: Lengths that share a block in the two-level suffix sums.
BLOCK = 1024


def length_histogram(counts: DataFrame, n_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs): how many documents have each encoded length; null counts as 0."""
    return counts.groupBy(F.coalesce(counts[n_col], F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, what a context limit of that length means.

    docs_up_to and tokens_up_to count the documents of at most that length,
    docs_over and tokens_over those beyond it, truncated_total the tokens left
    when every document is cut to the length, and quantile the share of
    documents up to it.  The sums within blocks of lengths are windows of
    their own and only the blocks' totals meet, so no task sees all lengths.
    An empty histogram gives no rows.  The histogram is written to the shared
    folder first, as both sums need it.
    """
    histogram = cut(histogram)
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over_d = F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + F.col("later_d")
    over_t = F.coalesce(F.sum("tokens").over(own), F.lit(0)) + F.col("later_t")
    out = rows.join(blocks, "block").select("length", "n_docs", over_d.alias("docs_over"), over_t.alias("tokens_over"), "all_d", "all_t")
    up_to = F.col("all_t") - F.col("tokens_over")
    return out.select("length", "n_docs", "docs_over", "tokens_over", (F.col("all_d") - F.col("docs_over")).alias("docs_up_to"), up_to.alias("tokens_up_to"), (up_to + F.col("length") * F.col("docs_over")).alias("truncated_total"), ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("quantile"))


def length_at_quantile(sums: DataFrame, q: float) -> DataFrame:
    """(length): the smallest length up to which a share q of the documents is; no row for an empty table."""
    return sums.where(F.col("quantile") >= q).agg(F.min("length").alias("length")).where("length is not null")
