"""Running sums, ranks, quantiles and pairs over a whole table, or within keys of it, without putting either into one task.

Values are dealt by value into buckets whose bounds are approximate quantiles;
sums and ranks run within a bucket, and what lies before a bucket is known
from the buckets' totals, of which there are at most ``BUCKETS`` a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, STEP = 64, 8
#: Accuracy of the approximate quantiles that bound buckets.
ACCURACY = 1000


def bucketed(distinct: DataFrame, value: str) -> DataFrame:
    """Rows with the column ``bucket``, which rises with the value."""
    return _placed(distinct, distinct, value, [])


def _placed(rows: DataFrame, source: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows with the column ``bucket``: how many of the cuts, of the row's key in ``source``, are below the value.

    Every ``STEP``-th cut is looked at first, then those before the first of
    them that isn't below.  A null value is in bucket 0.
    """
    cuts = source.groupBy(*by).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], ACCURACY).alias("cuts"))
    cuts = cuts.withColumn("coarse", F.transform(F.sequence(F.lit(STEP - 1), F.lit(BUCKETS - 2), F.lit(STEP)), lambda i: F.get("cuts", i)))
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    joined = rows.join(cuts, by) if by else rows.crossJoin(F.broadcast(cuts))
    joined = joined.withColumn("coarse", below("coarse"))
    return joined.withColumn("bucket", F.coalesce(F.col("coarse") * STEP + below(F.slice("cuts", F.col("coarse") * STEP + 1, F.lit(STEP))), F.lit(0))).drop("cuts", "coarse")


def counted(rows: DataFrame, value: str, by: list[str], **more: Column) -> DataFrame:
    """(by..., value, n, more..., bucket, upto, last): distinct values, how many rows have them, other aggregates of these rows, rows up to them, and rows of the key less one.

    Values are counted first, so a value that very many rows have is one row;
    the average rank of a value is upto - (n - 1) / 2.
    """
    known = rows.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in more.items()))
    placed = _placed(counts, known, value, by)
    few = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    totals = placed.groupBy(*by, "bucket").agg(F.sum("n").alias("m"))
    totals = totals.select(*by, "bucket", F.coalesce(F.sum("m").over(few), F.lit(0)).alias("before"), (F.sum("m").over(Window.partitionBy(*by)) - 1).alias("last"))
    own = Window.partitionBy(*by, "bucket").orderBy(value)
    return placed.withColumn("upto", F.sum("n").over(own)).join(totals, [*by, "bucket"]).withColumn("upto", F.col("upto") + F.col("before")).drop("before")


def midranks(rows: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """Rows with the average rank of equal values among those of the same key ``by``, from 1; a null value or key gets null."""
    ranks = counted(rows.select(*by, F.col(value).alias("_v")), "_v", list(by)).select(*(F.col(c).alias(f"_{c}") for c in by), "_v", (F.col("upto") - (F.col("n") - 1) / 2).alias(out))
    return rows.join(ranks, [F.col(value) == F.col("_v"), *(F.col(c) == F.col(f"_{c}") for c in by)], "left").select(*rows.columns, out)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(by..., a column for each share): exact quantiles, interpolated between neighbours; no task holds the values of a key.

    A key whose values are all null has no row.
    """
    values = counted(rows.select(*by, F.col(value).cast("double").alias("_v")), "_v", list(by))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("_v")))
    places = {n: F.col("last") * F.lit(q) for n, q in shares.items()}
    return values.groupBy(*by).agg(*((at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * F.max(p - F.floor(p))).alias(n) for n, p in places.items()))


def running(distinct: DataFrame, value: str, *sums: str) -> DataFrame:
    """Adds to rows of distinct values, for each column c of ``sums``: c_upto (sum over values up to this one) and c_all; and next, the following value."""
    rows = bucketed(distinct, value)
    own = Window.partitionBy("bucket").orderBy(value)
    per = rows.groupBy("bucket").agg(F.min(value).alias("least"), *(F.sum(c).alias(f"{c}_in") for c in sums))
    few = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row a bucket
    before = few.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    per = per.select("bucket", F.lead("least").over(few).alias("after"), *(F.coalesce(F.sum(f"{c}_in").over(before), F.lit(0)).alias(f"{c}_before") for c in sums), *(F.sum(f"{c}_in").over(every).alias(f"{c}_all") for c in sums))
    joined = rows.join(F.broadcast(per), "bucket")
    extra = {f"{c}_upto": F.sum(c).over(own) + F.col(f"{c}_before") for c in sums}
    return joined.withColumns(extra | {"next": F.coalesce(F.lead(value).over(own), F.col("after"))}).drop("bucket", "after", *(f"{c}_before" for c in sums))


def all_pairs(rows: DataFrame, key: str, value: str, blocks: int = 16) -> DataFrame:
    """(a, p, b, q): each pair a < b of distinct keys once, with their values, where the pairs are the result.

    Rows are dealt into blocks by the key's hash, and a pair of blocks meets
    by an equi-join, so a row is sent ``blocks`` times and no task sees all.
    """
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    every = rows.select(F.col(key).alias("k"), F.col(value).alias("v"), own.alias("block"))
    side = lambda n, others, lo, hi: every.select(F.col("k").alias(f"k{n}"), F.col("v").alias(f"v{n}"), "block", F.explode(others).alias("other")).select(f"k{n}", f"v{n}", F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    left = side(1, F.sequence("block", F.lit(blocks - 1).cast("long")), "block", "other")
    right = side(2, F.sequence(F.lit(0).cast("long"), "block"), "other", "block")
    met = left.join(right, ["lo", "hi"]).where((F.col("lo") < F.col("hi")) & (F.col("k1") != F.col("k2")) | (F.col("k1") < F.col("k2")))
    swap = F.col("k1") > F.col("k2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(pick("k1", "k2").alias("a"), pick("v1", "v2").alias("p"), pick("k2", "k1").alias("b"), pick("v2", "v1").alias("q"))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table to be broadcast if it has at most this many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
