"""Benchmark decontamination, by DataFrame expressions alone.

A document leaks an item if one of its windows, as long as the item, has a
weighted shingle similarity of 0.75 or more with it: shingles are five words,
weighted by how often they occur, and the similarity is the sum of the
smaller weights over the sum of the larger.

Windows of an item's size that could be similar to any item of that size, as
enough of their shingles occur in such items at all (an exact bound), get a SimHash.
Its features are the shingles and, for the second, third, ... occurrence of
one in the window, a feature of its own, so that the angle between the
fingerprints' vectors follows the weighted similarity and a repeated word
can't outweigh the others.  A multi-index over blocks of the fingerprints
finds the items: with one block more than the radius has bits, each pair
within the radius shares a block (pigeonhole), so none is lost.  Every
candidate within the radius is then compared exactly.

At similarity 0.75 two fingerprints differ in 11 of 64 bits on average, with
a deviation of 3; the radius of 23 leaves out about one pair in 20,000 there,
and fewer above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: Hamming distance up to which the index finds every pair of 64-bit fingerprints; it has one block more.
RADIUS = 23
#: Bytes up to which a table made of the items is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20


def bound(value: Column, use) -> Column:
    """use(value), with the value bound to a variable: it is evaluated once, even if ``use`` has it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, size: Column | int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer."""

    def own(w: Column) -> Column:
        n = F.size(w) - size + 1
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))

    return bound(words, own)


def similarity_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of the smaller and of the larger weights of two shingle arrays."""
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    weighted = F.aggregate(common, F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    both = F.when(plain, F.size(common)).otherwise(weighted)
    return both, F.size(a) + F.size(b) - both


def features_of(shingles: Column) -> Column:
    """The shingles of a window, the second and later occurrences of one as features of their own."""

    def own(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.when(F.get(s, i - 1) == x, F.xxhash64(x, i - F.array_position(s, x).cast("int") + 1)).otherwise(x))

    return bound(F.array_sort(shingles), own)


def fingerprint(features: Column) -> Column:
    """The 64-bit SimHash: a bit is set if it is in more than half of the features.

    Bits i and i+32 are counted in the two halves of one long.
    """
    ones = F.lit(1 << 32 | 1).cast("long")

    def own(f: Column) -> Column:
        zeros = F.array_repeat(F.lit(0).cast("long"), 32)
        sums = F.aggregate(f, zeros, lambda acc, x: F.transform(acc, lambda c, i: c + F.call_function("shiftrightunsigned", x, i).bitwiseAND(ones)))
        most = lambda c: F.when(c * 2 > F.size(f), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        low = lambda c: most(c.bitwiseAND(F.lit((1 << 32) - 1)))
        high = lambda c: most(F.shiftrightunsigned(c, 32))
        bits = F.transform(sums, lambda c, i: F.call_function("shiftleft", low(c), i).bitwiseOR(F.call_function("shiftleft", high(c), i + 32)))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return bound(features, own)


def _masks(radius: int) -> list[int]:
    """The bits of each block, as signed longs; sizes differ by one at most."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def near_pairs(windows: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``windows`` (m, print, ...) with those of ``index`` (m, item_print, ...) of the same m whose prints differ in ``radius`` bits at most, each pair once."""
    masks = _longs(_masks(radius))
    blocks = lambda p: F.posexplode(F.transform(masks, lambda k: p.bitwiseAND(k))).alias("block", "value")
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    pairs = windows.select("*", blocks(F.col("print"))).join(index.select("*", blocks(F.col("item_print"))), ["m", "block", "value"])
    first = F.forall(F.slice(masks, F.lit(1), F.col("block")), lambda k: apart.bitwiseAND(k) != 0)
    return pairs.where((F.bit_count(apart) <= radius) & first).drop("block", "value")


def _bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, n_windows, first_word, similarity) for each document and benchmark item it leaks.

    ``n_windows`` counts the windows that reach the similarity; ``first_word``
    is where the best one starts (the earliest of equals), counted in words.
    An item or text that is null or without words leaks nothing; an item of
    fewer than five words is one shingle; a document shorter than an item is
    one window.  Rows with a null id, of documents or items, are reported under null;
    rows that share an id are one document or item, each text by itself, and
    the same text under the same id counts once; extra columns aren't read.
    """
    items = benchmark.select(benchmark[item_col].alias("item"), words_of(benchmark[item_text_col]).alias("words")).where(F.size("words") > 0).distinct()
    size = F.least(F.size("words"), F.lit(SHINGLE))
    items = items.select("item", F.xxhash64("words").alias("row"), F.size("words").alias("m"), size.alias("k"), shingles_of(F.col("words"), size).alias("own"))
    stats = items.agg(F.collect_set("k").alias("sizes"), F.sum(F.size("own")).alias("shingles"), F.count("*").alias("n")).first()
    shingles = stats["shingles"] or 0
    flagged = _bounded(items.select("m", "k", F.explode("own").alias("shingle")).distinct(), 48 * shingles)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    version = F.xxhash64("text").alias("version")
    worded = texts.select("id", version, words_of(F.col("text")).alias("words"))
    hits = None
    for k in sorted(stats["sizes"]) or [SHINGLE]:
        at = worded.select("id", "version", F.size("words").alias("n"), F.posexplode(shingles_of(F.col("words"), k)).alias("p", "shingle"))
        some = at.join(flagged.where(F.col("k") == k), "shingle").drop("shingle")
        hits = some if hits is None else hits.unionByName(some)
    met = hits.groupBy("id", "version", "m", "k", "n").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    every = F.least("n", "m") + F.col("m") - 2 * F.col("k") + 2
    met = met.withColumn("need", F.ceil(every * percent / (100 + percent)).cast("int")).where(F.size("ps") >= F.col("need"))
    first = F.transform(F.sequence(F.lit(0), F.size("ps") - F.col("need")), lambda a: F.struct(F.get("ps", a).alias("lo"), F.get("ps", a + F.col("need") - 1).alias("hi")))
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    spans = F.transform(first, lambda s: F.struct(F.greatest(F.lit(0), s["hi"] - F.col("m") + F.col("k")).alias("from"), F.least(s["lo"], last).alias("to")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["from"] <= s["to"]), lambda s: F.sequence(s["from"], s["to"]))))
    asked = met.select("id", "version", "m", "k", starts.alias("starts")).where(F.size("starts") > 0)
    asked = asked.groupBy("id", "version").agg(F.collect_list(F.struct("m", "k", "starts")).alias("asked"))
    found = texts.withColumn("version", version).join(asked.withColumnRenamed("id", "own_id").withColumnRenamed("version", "v"), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("v")))
    found = found.dropDuplicates(["id", "version"]).select("id", words_of(F.col("text")).alias("words"), F.explode("asked").alias("a")).select("id", "words", "a.m", "a.k", "a.starts")
    cut = bound(shingles_of(F.col("words"), F.col("k")), lambda h: F.transform("starts", lambda at: F.struct(at.alias("at"), F.slice(h, at + 1, F.col("m") - F.col("k") + 1).alias("shingles"))))
    windows = found.select("id", "m", F.explode(cut).alias("w")).select("id", "m", "w.at", "w.shingles")
    windows = windows.withColumn("print", fingerprint(features_of(F.col("shingles"))))
    index = items.select("m", F.col("item").alias("i"), F.col("row").alias("r"), fingerprint(features_of(F.col("own"))).alias("item_print"))
    near = near_pairs(windows, _bounded(index, 96 * (radius + 1) * stats["n"]), radius)
    near = near.join(_bounded(items.select("item", "row", "own"), 8 * shingles + 96 * stats["n"]), F.col("item").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")))
    both, all_ = similarity_parts(F.col("shingles"), F.col("own"))
    checked = near.select("id", "item", "at", both.alias("both"), all_.alias("every")).where(F.col("both") * 100 >= F.col("every") * percent)
    best = F.max(F.struct((F.col("both") / F.col("every")).alias("similarity"), (-F.col("at")).alias("at")))
    out = checked.groupBy("id", "item").agg(F.count("*").alias("n_windows"), best.alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", (-F.col("best.at")).cast("long").alias("first_word"), F.col("best.similarity").alias("similarity"))
