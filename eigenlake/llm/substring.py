"""Repeated passages by prefix-partitioned suffix trees.

Every window of ``window`` words that another document has too is a path to a
deep internal node of the suffix tree of the corpus.  The tree is never built
whole: suffixes are split by a prefix into groups that fit a byte budget, and
each group has its own subtree.

A prefix is read from an anchor that depends on content alone: the first place
of the smallest 8-word gram (by hash) of the window.  So neighbouring suffixes
mostly share a prefix, and their text is sent once for a run of them; routed
by their own first words, each suffix would carry all words of its window.
Prefixes have variable length: at first the 8 words of the gram.  Where the
distinct text of a group is beyond the budget, its suffixes are split by the
place of the anchor in the window, which lengthens the prefix that all windows
of a part share to some 40 words, and at last to the whole window; then a
group is a single path of the tree.  Prefixes that only one document has can't lead to a repeat,
so a count of prefixes comes first and nothing else of such suffixes moves.

A run's text goes by its digest: equal texts of a group are in its subtree
once, with the smallest document that has them, so copies don't make a group
grow.  A subtree is held as its sorted suffixes: they get ranks at depths 1,
2, 4, ... up to the window, word by word, and a run of equal ranks is a node
as deep as a window.  Leaves under a node whose document isn't the node's
smallest are repeats; neighbouring ones join into maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .state import cut

#: Words of the shortest prefix.
PREFIX = 8
#: Places of the anchor in a window that share a part, by level of lengthening; the last level has one.
PLACES = (1 << 30, 11, 1)
#: Bytes of distinct text up to which the suffixes of a prefix are one group.
BUDGET = 1 << 22
#: Digests that a task keeps, so as to send equal texts once.
KEPT = 100_000


def _keys(part: W.Words, window: int, level: int, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The prefix of each window ``at``: hash of the words that all windows with the anchor in the same part share."""
    last = window - min(PREFIX, window)
    part_of = np.minimum((anchor - at) // PLACES[level], last)
    out, named = np.zeros(len(at), np.uint64), {}
    for c in np.unique(part_of):
        lo = int(c) * PLACES[level]
        hi = min(lo + PLACES[level] - 1, last)
        mine, depth = part_of == c, window - (hi - lo)
        if depth not in named:
            named[depth] = W.named(part.hashes, depth)
        out[mine] = W.mix(named[depth][anchor[mine] - lo] + np.uint64(c + 1) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _runs(part: W.Words, window: int, level: int, listed: np.ndarray | None, row: int):
    """First and last window, prefix and text of each run of windows of a slice that share a prefix.

    At a later level only windows are taken whose prefix of the level before
    is among the ``listed`` (of their row, which is ``row`` for the first text).
    """
    at = np.flatnonzero(part.inside(window))
    if not len(at):
        return None
    anchor = W.first_min(part.grams(min(PREFIX, window)), window - min(PREFIX, window) + 1)[at]
    if level:
        mine = _marked(_keys(part, window, level - 1, at, anchor), part.doc[at] + row, listed)
        at, anchor = at[mine], anchor[mine]
        if not len(at):
            return None
    key, doc = _keys(part, window, level, at, anchor), part.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], key[first], doc[first]


def _listed(lists: pa.Array) -> np.ndarray:
    """Sorted marks of the entries of a list column with their rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    return np.unique(_mark(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), row))


def _mark(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    return W.mix(key + W.mix(row.astype(np.uint64)))


def _marked(key: np.ndarray, row: np.ndarray, listed: np.ndarray) -> np.ndarray:
    mine = _mark(key, row)
    return listed[np.minimum(np.searchsorted(listed, mine), len(listed) - 1)] == mine if len(listed) else np.zeros(len(key), bool)


def _texts_of(part: W.Words, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    """The text of each run, and its digest as two longs."""
    text = part.between(lo, hi + window)
    return text, np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in text]), np.int64).reshape(-1, 2)


def _find(window: int, level: int):
    """(key, d1, d2, id, size) of each run of (id, text) rows, or of (id, text, keys of the level before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = _listed(b.column(2)) if level else None
            for part in W.words(b.column(1)):
                if (runs := _runs(part, window, level, listed, part.first)) is None:
                    continue
                lo, hi, key, doc = runs
                text, digest = _texts_of(part, lo, hi, window)
                yield pa.RecordBatch.from_arrays([W.longs(key), pa.array(digest[:, 0]), pa.array(digest[:, 1]), W.ids(b.column(0), part.first + doc), pa.array(list(map(len, text)), pa.int32())], ["key", "d1", "d2", "id", "size"])

    return run


def _version(data: bytes) -> int:
    """Tells texts apart that share an id."""
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _listed_runs(batches: Iterator[pa.RecordBatch], window: int, level: int):
    """The runs of (id, text, own keys, keys of the level before) rows whose prefix is an own key."""
    for b in batches:
        own, listed = _listed(b.column(2)), _listed(b.column(3)) if level else None
        for part in W.words(b.column(1)):
            if (runs := _runs(part, window, level, listed, part.first)) is None:
                continue
            lo, hi, key, doc = runs
            mine = _marked(key, doc + part.first, own)
            if mine.any():
                yield b, part, lo[mine], hi[mine], key[mine], doc[mine]


def _send(window: int, level: int):
    """(key, d1, d2, id, words) of the runs; a task sends a text once, and again only a smaller id for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for b, part, lo, hi, key, doc in _listed_runs(batches, window, level):
            text, digest = _texts_of(part, lo, hi, window)
            ids = W.ids(b.column(0), part.first + doc)
            at, words = [], []
            for i, (d, own) in enumerate(zip(map(bytes, digest), ids.to_pylist(), strict=True)):
                before = least.get(d)
                if before is None or own < before:
                    at.append(i)
                    words.append(text[i] if before is None else None)
                    if len(least) >= KEPT:
                        least.clear()
                    least[d] = own
            if at:
                yield pa.RecordBatch.from_arrays([W.longs(key[at]), pa.array(digest[at, 0]), pa.array(digest[at, 1]), ids.take(pa.array(at)), pa.array(words, pa.binary())], ["key", "d1", "d2", "id", "words"])

    return run


def _places(window: int, level: int):
    """(d1, d2, id, version, at, n) of the runs: where each stands and its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, lo, hi, _, doc in _listed_runs(batches, window, level):
            _, digest = _texts_of(part, lo, hi, window)
            texts = b.column(1).slice(part.first, part.n)
            version = np.zeros(part.n, np.int64)
            for i in np.unique(doc).tolist():
                version[i] = _version(texts[i].as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), W.ids(b.column(0), part.first + doc), pa.array(version[doc]), pa.array(lo - part.bound[doc], pa.int64()), pa.array(hi - lo + 1, pa.int64())], ["d1", "d2", "id", "version", "at", "n"])

    return run


def _distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Digests, smallest id and words of the texts of rows sorted by digest."""
    d = np.stack([rows["d1"].to_numpy(), rows["d2"].to_numpy()], axis=1)
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)]))
    words = rows["words"].combine_chunks()
    has = np.where(np.asarray(words.is_valid()), np.arange(len(d)), len(d))
    return d[first], np.minimum.reduceat(rows["id"].to_numpy(), first), words.take(pa.array(np.minimum.reduceat(has, first)))


def _subtrees(rows: pa.Table, window: int) -> pa.RecordBatch:
    """For each distinct text its smallest id and the spans of suffixes that a smaller id has in another text."""
    digest, ids, words = _distinct(rows)
    data, at = W.buffers(words.cast(pa.string()))
    part = W.split(0, data, at, W.WHITE_SPACE, False)
    first = np.flatnonzero(part.inside(window))
    row = part.doc[first]
    rank = W.ranked(part.codes, window)[first]
    order = np.argsort(rank, kind="stable")
    node = np.flatnonzero(np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]]))
    least = np.repeat(np.minimum.reduceat(ids[row[order]], node), np.diff(np.append(node, len(order))))
    repeat = np.sort(order[ids[row[order]] > least])
    start, row = first[repeat], row[repeat]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(start)) - 1 if len(lo) else lo
    base = part.bound[row[lo]]
    span = pa.StructArray.from_arrays([pa.array(start[lo] - base, pa.int64()), pa.array(start[hi] + window - base, pa.int64())], ["first", "last"])
    offsets = pa.array(np.searchsorted(row[lo], np.arange(len(ids) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids), pa.ListArray.from_arrays(offsets, span)], ["d1", "d2", "lo", "spans"])


def _grow(window: int):
    """Subtrees of rows sorted by prefix and digest; whole groups are handled together up to the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for lo in range(0, len(whole), 5000):
                b = whole.slice(lo, 5000)
                d = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
                same = np.concatenate([[False], (d[1:] == d[:-1]).all(axis=1)])
                if same.any():  # of equal texts in a row, the first with words and the smallest id are enough
                    b = _fewer(b, same)
                held.append(b)
                size += b.column(4).nbytes
                key = b.column(0).to_numpy()
                if size < BUDGET or not (edge := np.flatnonzero(key[1:] != key[:-1])).size:
                    continue
                to = int(edge[-1]) + 1
                held[-1] = b.slice(0, to)
                yield _subtrees(pa.Table.from_batches(held), window)
                held = [b.slice(to)]
                size = held[0].column(4).nbytes
        if held:
            yield _subtrees(pa.Table.from_batches(held), window)

    return run


def _fewer(b: pa.RecordBatch, same: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(~same)
    has = np.where(np.asarray(b.column(4).is_valid()), np.arange(len(same)), len(same))
    words = b.column(4).take(pa.array([x if x < len(same) else None for x in np.minimum.reduceat(has, first).tolist()], pa.int64()))
    return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(first)) for i in (0, 1, 2)), pa.array(np.minimum.reduceat(b.column(3).to_numpy(), first)), words], b.schema.names)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts under names of their own, by the same expressions each time, so that joins by id can share one exchange of the texts."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("body"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, version, first, last): word spans, last exclusive, of windows that start in a document with a smaller id too.

    ``version`` tells texts apart that share an id.  Spans of one text may
    touch or overlap.  See ``remove_repeats`` for words, nulls and ties.
    """
    texts = _texts(docs, id_col, text_col).where("id is not null")
    source, found = texts, None
    for level in range(len(PLACES)):
        runs = source.mapInArrow(_find(window, level), "key long, d1 long, d2 long, id long, size int")
        distinct = runs.groupBy("key", "d1", "d2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("size").alias("size"))
        groups = distinct.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size")).where("lo < hi")
        longer = (F.col("size") > BUDGET) & F.lit(level + 1 < len(PLACES))
        shared = cut(groups.select("key", longer.alias("longer")))
        lists = runs.select("key", "id").join(shared, "key").groupBy("id").agg(F.collect_set(F.when(~F.col("longer"), F.col("key"))).alias("own"), F.collect_set(F.when(F.col("longer"), F.col("key"))).alias("longer"))
        lists = cut(lists)
        before = F.col("listed") if level else F.lit(None).cast("array<long>")
        at = source.join(lists, "id").select("id", "body", "own", before.alias("listed"), "longer")
        own = at.where(F.size("own") > 0).select("id", "body", "own", "listed")
        sent = own.mapInArrow(_send(window, level), "key long, d1 long, d2 long, id long, words binary")
        trees = sent.repartition("key").sortWithinPartitions("key", "d1", "d2").mapInArrow(_grow(window), "d1 long, d2 long, lo long, spans array<struct<first: long, last: long>>")
        places = own.mapInArrow(_places(window, level), "d1 long, d2 long, id long, version long, at long, n long")
        met = places.join(trees, ["d1", "d2"]).where((F.col("id") > F.col("lo")) | (F.size("spans") > 0))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n") + window - 1).alias("last")))
        met = met.select("id", "version", "at", F.explode(F.when(F.col("id") > F.col("lo"), whole).otherwise(F.col("spans"))).alias("s"))
        spans = met.select("id", "version", (F.col("at") + F.col("s.first")).alias("first"), (F.col("at") + F.col("s.last")).alias("last"))
        found = spans if found is None else found.unionByName(spans)
        if shared.where("longer").isEmpty():
            break
        source = at.where(F.size("longer") > 0).select("id", "body", F.col("longer").alias("listed"))
    return found


def _keep(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
    """Words, removed words and kept text."""
    data = (text or "").encode()
    have = data.split()
    drop = np.zeros(len(have) + 1, np.int64)
    if spans:
        own = _version(data)
        for x in spans:
            if x["version"] == own:
                drop[x["first"]] += 1
                drop[x["last"]] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    n = int(gone.sum())
    return len(have), n, b" ".join([have[i] for i in np.flatnonzero(~gone)] if n else have).decode()


def _strip(names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                out = [text if not spans or not (kept := _keep(text, spans))[1] else kept[2] for text, spans in zip(part.column(names.index(text_col)).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_col else part.column(i) for i, n in enumerate(names)], names)

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """The rows and columns of ``docs``, with the kept words in place of a text that lost some; others stay as they are."""
    spans = repeated_spans(docs, id_col, text_col, window).groupBy("id").agg(F.collect_list(F.struct("version", "first", "last")).alias("spans"))
    own = docs.withColumnsRenamed({c: f"own_{i}" for i, c in enumerate(docs.columns)})
    key = f"own_{docs.columns.index(id_col)}"
    joined = own.join(spans, own[key].cast("long") == spans["id"], "left").select(*own.columns, "spans")
    return joined.toDF(*docs.columns, "~spans").mapInArrow(_strip(docs.columns, text_col), docs.schema)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 500):
            part = b.slice(at, 500)
            total, removed, kept = zip(*map(_keep, part.column(1).to_pylist(), part.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row of ``docs``.

    Removed are the words covered by a window of ``window`` consecutive words
    whose words also stand in a row in a document with a smaller id; windows
    are judged on the input.  Words are runs of anything but ASCII white
    space; kept words are joined by one space.  Ids are longs.  A null or
    empty text has no words; a text shorter than a window keeps all; a row
    without an id neither loses words nor makes others lose them; rows that
    share an id don't count as one another's predecessors and come back as
    often as they came.  Other columns aren't read.
    """
    texts = _texts(docs, id_col, text_col)
    known, nameless = texts.where("id is not null"), texts.where("id is null")
    spans = repeated_spans(docs, id_col, text_col, window).groupBy("id").agg(F.collect_list(F.struct("version", "first", "last")).alias("spans"))
    joined = known.join(spans, "id", "left").select("id", "body", "spans")
    every = joined.unionByName(nameless.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    return every.mapInArrow(_remove, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
