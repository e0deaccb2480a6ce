"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine.

Vectors are normalised; in each of several tables a vector's key is a row of
quantised random projections, floor((a.x + b) / w) with Gaussian a.  Vectors
that share a key in a table are compared exactly, in double precision.  Equal
vectors are one class from the start.  A bucket with many members is split
into blocks, and each pair of blocks is a task of bounded size that multiplies
two small matrices: it returns a number of links a vector and a spanning set
of edges, never the pairs.  A pair is counted in the first table in which it
meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .graph import components
from .state import cut

WIDTH = 2.0
#: Share of pairs at the least cosine that may meet in no table.
MISSED = 0.0005
#: Distinct vectors for which 16 projections do; each doubling takes one more.
FOR_16 = 1 << 14
#: Members of one block of a bucket, about.
BLOCK = 512
#: Members of a bucket up to which its pairs are compared along with those of other buckets.
FEW = 32
_drawn: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def units_of(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, values and values at length 1 of the vectors of each size that can link."""
    lists = pa.concat_arrays([vectors.cast(pa.list_(pa.float64()))])
    starts = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False) + 0.0
    bad = np.concatenate([[0], np.cumsum(np.asarray(lists.values.is_null()) | ~np.isfinite(values))])
    size = np.diff(starts)
    whole = np.asarray(lists.is_valid()) & (size > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    for n in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == n))
        x = values[starts[rows][:, None] + np.arange(n)]
        top = np.abs(x).max(axis=1)
        rows, x, top = rows[top > 0], x[top > 0], top[top > 0, None]
        if len(rows):
            u = x / top
            yield rows, x, u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def settings(n: int, least: float = 0.95, width: float = WIDTH, missed: float = MISSED) -> tuple[int, int]:
    """Tables and projections for n distinct vectors.

    Two vectors at distance c share a cell of a projection with probability
    1 - erfc(r/sqrt 2) - (1 - exp(-r*r/2)) * sqrt(2/pi)/r at r = width / c.  At
    right angles that is about one half, so one more projection a doubling of n
    keeps the chance pairs a vector meets in a bucket, and the tables follow so
    that a pair at the least cosine is missed by all of them with probability ``missed``.
    """
    projections = 16 + max(0, math.ceil(math.log2(max(n, 1) / FOR_16)))
    r = width / math.sqrt(max(2 - 2 * least, 1e-12))
    share = 1 - math.erfc(r / math.sqrt(2)) - (1 - math.exp(-r * r / 2)) * math.sqrt(2 / math.pi) / r
    return math.ceil(math.log(missed) / math.log1p(-(share**projections))), projections


def keys(units: np.ndarray, tables: int, projections: int, width: float = WIDTH) -> np.ndarray:
    """The bucket of each vector in each table, as uint64."""
    d = units.shape[1]
    if (d, tables, projections) not in _drawn:
        draw = np.random.default_rng([7, d])
        _drawn[d, tables, projections] = draw.standard_normal((d, tables * projections)), draw.random(tables * projections)
    a, b = _drawn[d, tables, projections]
    cell = np.floor(units @ a / width + b).astype(np.int64).view(np.uint64).reshape(len(units), tables, projections)
    h = np.full((len(units), tables), d, np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(1 << 32)
    for i in range(projections):
        h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, i])
    return h


def _classes(vectors: bool):
    """The class of each row, and with ``vectors`` its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, known = np.zeros((len(b), 2), np.int64), np.zeros(len(b), bool)
            for rows, x, _ in units_of(b.column(1)):
                digests = b"".join([xxhash.xxh3_128_digest(v.tobytes()) for v in x])
                name[rows], known[rows] = np.frombuffer(digests, np.int64).reshape(-1, 2), True
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(name[:, c], mask=~known) for c in (0, 1)), *b.columns[1 : 2 if vectors else 1]], ["id", "c1", "c2"] + ["vector"] * vectors)

    return run


def _buckets(tables: int, projections: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                for rows, _, units in units_of(part.column(1)):
                    k = keys(units, tables, projections, width)
                    yield pa.RecordBatch.from_arrays([W.ids(part.column(0), rows), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), W.longs(k.reshape(-1)))], ["id", "keys"])

    return run


def _pairs(units: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of the same group, which is a run of rows, whose cosine is at least ``least``."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(edge)
    left, right = [], []
    for lo, hi in zip(edge[:-1][size > FEW].tolist(), edge[1:][size > FEW].tolist(), strict=True):
        i, j = np.nonzero(np.triu(units[lo:hi] @ units[lo:hi].T >= least, 1))
        left.append(lo + i)
        right.append(lo + j)
    few = np.flatnonzero(np.repeat(size <= FEW, size))
    for step in range(1, FEW):  # neighbours at each step in the runs of few rows
        i = few[:-step][group[few[:-step]] == group[few[step:]]]
        if not len(i):
            break
        hit = (units[i] * units[i + step]).sum(axis=1) >= least
        left.append(i[hit])
        right.append(i[hit] + step)
    return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])


def _link(least: float, tables: int, projections: int, width: float):
    """Compares the members of each (bucket, block, block); rows, sorted by the first four: t, key, lo, hi, block, id, weight, vector."""

    def task(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        t, lo, hi, block, ids, weight = (rows[c].to_numpy() for c in ("t", "lo", "hi", "block", "id", "weight"))
        out = [[], [], []]
        for at, _, units in units_of(rows["vector"].combine_chunks()):  # members of a bucket have one size
            i, j = _pairs(units, group[at], least)
            apart = (lo[at[i]] == hi[at[i]]) | (block[at[i]] != block[at[j]])
            i, j = i[apart], j[apart]
            hit, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            if not len(hit):
                continue
            a, b = place[: len(i)], place[len(i) :]
            own = np.concatenate([keys(units[hit[x : x + 1000]], tables, projections, width) for x in range(0, len(hit), 1000)])
            first, links = np.ones(len(a), bool), np.zeros(len(hit), np.int64)
            for x in range(0, len(a), 20_000):  # a pair counts in the first table in which it meets
                met = own[a[x : x + 20_000]] == own[b[x : x + 20_000]]
                first[x : x + 20_000] = met.argmax(axis=1) == t[at[i[x : x + 20_000]]]
            np.add.at(links, a[first], weight[at[hit[b[first]]]])
            np.add.at(links, b[first], weight[at[hit[a[first]]]])
            root = np.arange(len(hit))
            while True:
                new = root.copy()
                np.minimum.at(new, b, root[a])
                np.minimum.at(new, a, root[b])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            for have, x in zip(out, (ids[at[hit]], links, ids[at[hit[root]]]), strict=True):
                have.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in out], ["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def named(rows: pa.Table) -> np.ndarray:
            name = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("t", "key", "lo", "hi")], axis=1)
            return np.cumsum(np.concatenate([[True], (name[1:] != name[:-1]).any(axis=1)]))

        for whole in batches:
            for at in range(0, len(whole), 5000):
                rows = pa.Table.from_batches([*held, whole.slice(at, 5000)])
                group = named(rows)
                to = int(np.searchsorted(group, group[-1]))  # the last bucket may go on
                if to:
                    yield task(rows.slice(0, to), group[:to])
                held = rows.slice(to).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield task(rows, named(rows))

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int | None = None, projections: int | None = None, width: float = WIDTH) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Links are pairs found with cosine >= ``least``, equal vectors included;
    ``component_id`` is the smallest id that links reach.  Ids are longs.
    Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing, nor do vectors of different sizes; a row without an id
    is counted by no other, has 0 links and a null component and is kept;
    repeated rows are vectors of their own that link with each other, and rows
    that share an id but not the vector have links and a component each.
    Other columns aren't read.

    Tables and projections follow from the number of distinct vectors, see
    ``settings``: at the least cosine a pair is missed five times in ten
    thousand, and beyond it less often.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    base = cut(rows.select("id", "vector").mapInArrow(_classes(False), "id long, c1 long, c2 long"))
    known = base.where("id is not null and c1 is not null")
    classes = cut(known.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()))
    own = settings(classes.count(), least, width)
    tables, projections = tables or own[0], projections or own[1]
    named = rows.where("id is not null").mapInArrow(_classes(True), f"id long, c1 long, c2 long, vector {rows.schema['vector'].dataType.simpleString()}")
    same = [named[c] == classes[c] for c in ("c1", "c2")] + [named["id"] == classes["rep"]]
    reps = cut(named.join(classes, same).select(F.col("node").alias("id"), "vector", "weight").dropDuplicates(["id"]))
    keyed = reps.select("id", "vector").mapInArrow(_buckets(tables, projections, width), "id long, keys array<long>").select("id", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = keyed.join(sizes, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("id", "t"), blocks).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    tasks = pairs.select("t", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id").join(reps, "id").select("t", "key", "lo", "hi", "block", "id", "weight", F.col("vector"))
    order = ["t", "key", "lo", "hi"]
    found = cut(tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_link(least, tables, projections, width), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found, "id", "root")
    lowest = classes.join(roots, "node").groupBy("root").agg(F.min("rep").alias("lowest"))
    full = classes.join(links, classes["node"] == links["id"], "left").join(roots, "node", "left").join(lowest, "root", "left")
    full = cut(full.select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "rep").alias("component")))
    joined = base.alias("v").join(full.alias("c"), [F.col(f"v.{c}") == F.col(f"c.{c}") for c in ("c1", "c2")] + [F.col("v.id").isNotNull()], "left")
    component = F.coalesce(F.col("c.component"), F.col("v.id"))
    return joined.select(F.col("v.id").alias(id_col), F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("v.id") == component, F.lit(True)).alias("kept"))
