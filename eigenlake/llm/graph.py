"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import cut

#: Edges beyond which a node is a hub, if that is more than the ``HUBS``-th part of all edge ends; so there are at most ``HUBS`` hubs.
HUB, HUBS = 100, 20_000
#: Edges that a task contracts at once.
AT_ONCE = 1 << 18


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root) of a graph in memory: each node, sorted, and the smallest one it is connected with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, ``AT_ONCE`` at a time, as an edge from each node to the smallest one they reach."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        nodes, root = roots(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2)))
        some = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some])], ["u", "v"])

    for b in batches:
        held.append(b)
        n += len(b)
        if n >= AT_ONCE:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _lowest(rows: DataFrame, ends: int) -> DataFrame:
    """``rows`` (u, v), v neighbours of u, with m, the smallest v of u.

    The edges of a hub stay where they are, as its m is broadcast (there are
    at most ``HUBS`` hubs); only the others are shuffled to their node.
    """
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    limit = max(HUB, ends // HUBS)
    hubs = F.broadcast(low.where(F.col("degree") > limit).select("u", "m"))
    others = low.where(F.col("degree") <= limit).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(others, "u"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    Large-star and small-star steps in turn, each one aggregation and one join
    on the edge table, until only stars are left: about log(longest path)
    rounds.  Before them and after each one, tasks contract the edges they have.  The result of each step
    is written, so that plans don't grow.
    A node with very many edges is safe: the minimum of its neighbours is
    taken by a map-side aggregate and broadcast.  Loops and repeated edges are
    allowed; edges with a null end are ignored.
    """
    kind = "u {}, v {}".format(*(edges.schema[c].dataType.simpleString() for c in (a, b)))
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = cut(pairs.mapInArrow(_contract, kind).distinct())
    while True:
        # settled: every node has one edge, to a node that has none
        now = pairs.groupBy("u").agg(F.count("*").alias("up"), F.lit(0).alias("down")).unionByName(pairs.groupBy(F.col("v").alias("u")).agg(F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")))
        now = now.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.sum("up").alias("n"), F.max(F.col("up") + F.col("down")).alias("most")).first()
        if not now["n"] or now["most"] == 1:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        ends = 2 * now["n"]
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_lowest(both, ends).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).mapInArrow(_contract, kind).distinct())
        small = _lowest(large, ends)
        pairs = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        pairs = cut(pairs.mapInArrow(_contract, kind).distinct())
