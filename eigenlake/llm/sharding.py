"""Shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of slots, about.
BLOCK = 100_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the walk of jumps that ends at ``shards``, for all keys at once.

    A key's jumps depend on the key alone, so with one more shard a key stays
    or goes to the new one.  There is no table of shards.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, to = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        at[going] = to[going]
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        stride = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        to[going] = np.minimum((at[going] + 1) * stride, float(1 << 62)).astype(np.int64)
        going = going[to[going] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key; null goes where key 0 goes."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards))

    return run(F.coalesce(key.cast("long"), F.lit(0)))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; law is ``key``.

    The id and the number of shards decide; ``grown_shard`` is where one more
    shard would leave the row.  ``size`` is the text's UTF-8 bytes plus 1 (a
    null text has none), ``text_crc32`` of these bytes.  ``slot`` counts a
    shard's rows from 0 without gaps: rows are numbered in blocks of their
    ids' hash, with the sizes of the earlier blocks added, so no task sees a
    whole shard.  Repeated rows get slots of their own; rows with a null id
    are held as key 0.  An empty table gives no rows.
    """
    data = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"), shard_of(docs[id_col], shards).alias("shard"), shard_of(docs[id_col], shards + 1).alias("grown_shard"))
    blocks = max(1, docs.count() // (shards * BLOCK) + 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks * 8)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")) - 1
    out = rows.withColumn("number", number).join(starts, ["shard", "block"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"), "grown_shard")
