"""Vectorised word hashing over Arrow string columns.

Texts are read straight from the Arrow buffers: word bounds, word hashes and
word n-gram hashes are NumPy passes over a slice of the batch.  Where words
must be told apart for certain, those of a slice are dictionary-encoded by
their bytes: equal codes are equal words.  A slice holds about
``SLICE_BYTES`` of text (a longer single text is a slice of its own), which
bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

_GRAM = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a word that are mixed in eight at a time; a longer word is hashed by XXH3.
_SHORT = 64
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def delimited(delimiters: str) -> np.ndarray:
    """Byte table for words that are runs of bytes outside ``delimiters`` (code points below 128)."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in delimiters]] = False
    return table


_ONE_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Words are runs of anything but ASCII white space.
WHITE_SPACE = delimited("\t\n\x0b\x0c\r ")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of the texts first..first+n-1 of a batch, in order.

    ``doc`` is the text of each word, ``bound`` the first word of each text and
    a last entry; ``starts`` and ``ends`` are byte positions in ``data``.
    """

    first: int
    n: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray

    @cached_property
    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words of the slice."""
        size = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=size[1:])
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        own = np.ascontiguousarray(self.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(size), pa.py_buffer(own)])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k-1 entries of the slice have none."""
        h, n = self.hashes, len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = h[:n].copy()
        for i in range(1, k):
            out *= _GRAM
            out += h[i : i + n]
        return mix(out + np.uint64(k))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def between(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words (between white space) first..last, exclusive, of a text joined by single spaces, for each pair of places."""
        data, last = self.data.tobytes().translate(_ONE_SPACE), np.maximum(last, first)
        odd = np.zeros(len(self.starts) + 1, np.int64)  # gaps before each word that aren't one byte
        odd[1:-1] = self.starts[1:] != self.ends[:-1] + 1
        odd = np.cumsum(odd)
        lo = np.append(self.starts, 0)[first].tolist()
        hi = np.append(self.ends, 0)[last - 1].tolist()
        plain = (odd[np.maximum(last - 1, first)] == odd[first]).tolist()
        some = (last > first).tolist()
        return [(data[a:b] if p else b" ".join(data[a:b].split())) if s else b"" for a, b, p, s in zip(lo, hi, plain, some, strict=True)]

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one text."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.empty(0, dtype=bool)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, table: np.ndarray = WHITE_SPACE, lower: bool = False) -> Iterator[Words]:
    """Slices of the column, each with whole texts."""
    data, offsets = buffers(texts)
    first, last = 0, len(offsets) - 1
    while first < last:
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        at = offsets[first : to + 1] - offsets[first]
        yield split(first, data[offsets[first] : offsets[to]], at, table, lower)
        first = to


def split(first: int, data: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    n = len(data)
    word = table[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
    bound = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bound))
    return Words(first, len(at) - 1, data, starts, ends, doc, bound, hash_words(data, starts, ends))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _GRAM + np.uint64(0x9E3779B97F4A7C15)
    rows, at = np.arange(len(starts)), 0
    while len(rows):
        h[rows] = mix(h[rows] * _GRAM ^ (eight[starts[rows] + at] & _FIRST[np.minimum(size[rows] - at, 8)]))
        at += 8
        rows = rows[(size[rows] > at) & (size[rows] <= _SHORT)]
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def hash_word(word: str) -> int:
    """The hash that ``words`` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0])


def named(h: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` words from each word on, from hashes at depths that double."""
    have, factor = 1, np.uint64(0x9E3779B97F4A7C15)
    while 2 * have <= depth:
        h = mix(h[: max(len(h) - have, 0)] * factor + h[have:])
        have *= 2
    rest = depth - have
    return mix(h[: max(len(h) - rest, 0)] * factor + h[rest:]) if rest else h


def ranked(codes: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the ``depth`` words from each word on among all of the slice, word by word, from ranks at depths that double.

    Equal ranks are equal words; the order is that of the codes, lexicographic.
    """
    have, r = 1, codes
    while have < depth:
        step = min(have, depth - have)
        r = r[: max(len(r) - step, 0)] * (int(r.max(initial=0)) + 1) + r[step:]
        r = np.unique(r, return_inverse=True)[1].reshape(-1)
        have += step
    return r


def first_min(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the minimum, the first of equals, of each w consecutive entries, by doubling."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return np.empty(0, np.int64)

    def of(place: np.ndarray, step: int) -> np.ndarray:
        left, right = place[: len(place) - step], place[step:]
        return np.where(x[left] <= x[right], left, right)

    place = np.arange(len(x))
    while 2 * have <= w:
        place = of(place, have)
        have *= 2
    return of(place, w - have)[:n] if have < w else place[:n]


def ids(column: pa.Array, rows: np.ndarray) -> pa.Array:
    """The entries of a column at these rows."""
    return column.take(pa.array(rows.astype(np.int64)))


def longs(x: np.ndarray) -> pa.Array:
    """uint64 as Spark's signed long, bit for bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
