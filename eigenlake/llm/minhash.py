"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document's set is its distinct word shingles (a shorter text is one shingle,
its whole word sequence).  One permutation of the hashed universe places every
shingle, and circular shifts of a second one give all coordinates of the
signature, so two permutations stand in for one a coordinate.

Nothing is decided by a signature alone: links are confirmed on the full sets,
word by word.  Documents of equal words in a row are one class from the
start.  Not all pairs of a bucket are formed: first each bucket's smallest
document is held against the others, which connects most of a group of near
copies at one comparison a member.  Buckets that are in one component then are
done.  In the others, members that aren't in the bucket's largest component
are held against all members, inside a task, as a product of two 0/1 matrices
over the shingles; large buckets are split into pairs of blocks, bounded by
their shingles.  A task returns a spanning set of edges, at most one a member,
each confirmed word by word.  So every pair that meets is confirmed, refuted,
or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .graph import components
from .state import cut

BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
#: Members, and shingles of the members, of one block of a bucket, about.
BLOCK, SHINGLES = 1024, 1 << 18
#: Bytes of text that are confirmed at once.
AT_ONCE = 1 << 21
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _permutations(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and the shifted one, with its first n entries again at its end."""
    if (seed, n) not in _tables:
        draw = np.random.default_rng(seed)
        place, shifted = draw.permutation(UNIVERSE).astype(np.int32), draw.permutation(UNIVERSE).astype(np.int32)
        _tables[seed, n] = place, np.concatenate([shifted, shifted[:n]])
    return _tables[seed, n]


def shingle_sets(part: W.Words, k: int) -> list[np.ndarray]:
    """For each text of a slice the sorted distinct hashes of its shingles."""
    grams, out = part.grams(k), []
    for lo, hi in zip(part.bound[:-1], part.bound[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            whole = np.uint64(0)
            for h in part.hashes[lo:hi]:
                whole = W.mix(np.array([whole]) * np.uint64(31) + h)[0]
            out.append(W.mix(np.array([whole]) + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its set of shingles, named so that equal names are equal words among these texts."""
    data, at = W.buffers(texts)
    part = W.split(0, data, at, W.WHITE_SPACE, True)
    rank, whole, out = W.ranked(part.codes, k), {}, []
    for lo, hi in zip(part.bound[:-1], part.bound[1:], strict=True):
        if 0 < hi - lo < k:
            out.append(np.array([-1 - whole.setdefault(tuple(part.codes[lo:hi].tolist()), len(whole))]))
        else:
            out.append(np.unique(rank[lo : max(lo, hi - k + 1)]))
    return out


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def signatures(sets: list[np.ndarray], n: int, seed: int = 1) -> np.ndarray:
    """n coordinates for each set, none of which is empty."""
    place, shifted = _permutations(seed, n)
    at = place[(np.concatenate(sets) & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    first = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(shifted[at + i], first) for i in range(n)], axis=1)


def _describe(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in W.words(b.column(1), lower=True):
                sets = shingle_sets(part, shingle)
                size = np.array([len(x) for x in sets])
                full = np.flatnonzero(size)
                key = np.zeros((part.n, bands), np.uint64)
                if len(full):
                    sig = signatures([sets[i] for i in full], bands * rows).astype(np.uint64)
                    for j in range(bands):
                        h = np.full(len(full), j + 1, np.uint64)
                        for x in range(j * rows, j * rows + rows):
                            h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, x])
                        key[full, j] = h
                keys = pa.ListArray.from_arrays(pa.array(np.arange(part.n + 1, dtype=np.int32) * bands), W.longs(key.reshape(-1)))
                digest = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in part.between(part.bound[:-1], part.bound[1:])]), np.int64).reshape(-1, 2)
                rows_of = b.column(0).slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([rows_of, pa.array(size.astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), keys], ["id", "n", "s1", "s2", "bands"])

    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, linked, at = sum(W.buffers(b.column(i))[1][1:] for i in (2, 3)), [], 0
            while at < len(b):
                before = int(size[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(size, before + AT_ONCE, "right")) - at)
                sets = exact_sets(pa.concat_arrays([b.column(2).slice(at, n), b.column(3).slice(at, n)]), shingle)
                linked += [_similar(x, y, percent) for x, y in zip(sets[:n], sets[n:], strict=True)]
                at += n
            keep = b.filter(pa.array(linked, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], ["a", "b"])

    return run


def _linked(sets: list[np.ndarray], rows: np.ndarray, percent: int) -> np.ndarray:
    """Which members the members ``rows`` link with, from products over the shingles that at least two members have."""
    size = np.array([len(x) for x in sets])
    every, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, df = np.unique(every, return_inverse=True, return_counts=True)
    shared = df[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    member, order = member[shared], np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    both = np.zeros((len(rows), len(sets)), np.float32)
    step = max(1, (1 << 22) // len(sets))
    for lo in range(0, len(names), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((len(sets), min(step, len(names) - lo)), np.float32)
        part[member[a:b], column[a:b] - lo] = 1
        both += part[rows] @ part.T
    return 100 * both >= percent * (size[rows][:, None] + size[None, :] - both)


def _spanning(linked: np.ndarray, label: np.ndarray, confirmed) -> list[tuple[int, int]]:
    """Edges between members that connect what confirmed links connect, beyond equal labels; ``linked`` is symmetric."""
    order = np.argsort(label, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(label))[:-1])
    seen, out = np.zeros(len(members), bool), []
    for first in range(len(members)):
        if seen[first]:
            continue
        seen[first], queue = True, members[first].tolist()
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(linked[i] & ~seen[label]).tolist():
                if not seen[label[j]] and confirmed(i, j):
                    seen[label[j]] = True
                    out.append((i, j))
                    queue += members[label[j]].tolist()
    return out


def _settle(shingle: int, percent: int):
    """Decides what is open in each (bucket, block, block); rows: key, lo, hi, block, id, label, text."""

    def task(rows: pa.Table) -> list[tuple[int, int]]:
        texts = rows["text"].combine_chunks()
        ids, labels, block = (rows[c].to_numpy() for c in ("id", "label", "block"))
        _, label, n = np.unique(labels, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(label != np.argmax(n))
        if not len(open_):
            return []
        sets = [s for part in W.words(texts, lower=True) for s in shingle_sets(part, shingle)]
        linked = np.zeros((len(sets), len(sets)), bool)
        linked[open_] = _linked(sets, open_, percent)
        linked |= linked.T
        if rows["lo"][0] != rows["hi"][0]:
            linked &= block[:, None] != block[None, :]

        def confirmed(i: int, j: int) -> bool:
            return _similar(*exact_sets(texts.take(pa.array([i, j])), shingle), percent)

        return [(int(ids[i]), int(ids[j])) for i, j in _spanning(linked, label, confirmed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, out = None, []
        for b in batches:
            name = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(axis=1)]))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(b)], strict=True):
                if held and tuple(name[lo]) != last:
                    out += task(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = tuple(name[lo])
        if held:
            out += task(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Ids are longs.  ``component_id`` is the smallest id that links reach;
    ``kept`` says that it is the row's own.  Words are runs of anything but
    ASCII white space, with A-Z in lower case.  A null or wordless text has an
    empty set and links with nothing; a row without an id has a null
    ``component_id`` and is kept; rows that share an id are one document and
    come back as often as they came.  Other columns aren't read.

    With ``bands`` of ``rows`` coordinates, a pair at similarity s meets with
    probability 1-(1-s^rows)^bands: at 32 of 4 a pair at 0.75 is missed five
    times in a million.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sig = cut(texts.mapInArrow(_describe(shingle, bands, rows), "id long, n long, s1 long, s2 long, bands array<long>"))
    known = sig.where("n > 0 and id is not null")
    classes = cut(known.groupBy("s1", "s2").agg(F.min("id").alias("rep")))
    reps = known.alias("d").join(classes, [F.col("d.id") == F.col("rep"), *(F.col(f"d.{c}") == classes[c] for c in ("s1", "s2"))]).select("d.id", "d.n", "d.bands").distinct()
    members = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    active = cut(members.join(shared, "key").select("key", "id", "n", F.col("id").alias("label")))
    found = cut(texts.join(active.select("id").distinct(), "id", "left_semi"))
    pivots = active.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"))
    pairs = active.join(pivots, "key").where(F.col("id") != F.col("p.id")).where(F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent)
    pairs = pairs.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    edges = cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, percent), "a long, b long"))
    labels = components(edges, "a", "b")
    rest = active.join(pivots.select("key", F.col("p.id").alias("id")), ["key", "id"], "left_anti")
    rest = cut(rest.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("label")))
    buckets = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("first")).where("lo < hi")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") / SHINGLES)).cast("int")
    buckets = buckets.groupBy("m", "n", "x", "first").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks"))  # buckets of the same members are one
    placed = rest.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.where("blocks = 1").select("key", "id", "label", "block", F.lit(0).alias("other")).unionByName(placed.where("blocks > 1").select("key", "id", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    tasks = placed.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "label").join(found, "id").select("key", "lo", "hi", "block", "id", "label", "text")
    new = tasks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_settle(shingle, percent), "a long, b long")
    new = cut(new)
    if not new.isEmpty():
        # each edge joins two known components by members of theirs
        labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new), "a", "b")
    classes = classes.join(labels, classes["rep"] == labels["node"], "left").select("s1", "s2", F.coalesce("root", "rep").alias("rep"))
    joined = sig.alias("d").join(cut(classes).alias("c"), [F.col(f"d.{c}") == F.col(f"c.{c}") for c in ("s1", "s2")] + [F.col("d.n") > 0, F.col("d.id").isNotNull()], "left")
    component = F.coalesce(F.col("c.rep"), F.col("d.id"))
    return joined.select(F.col("d.id").alias(id_col), F.col("d.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("d.id") == component, F.lit(True)).alias("kept"))
