"""Byte-level BPE by longest match and backtracking.

The vocabulary's tokens are mapped byte by byte to Latin-1 and held in the
trie of an Aho-Corasick automaton.  A piece of text is encoded by trying, at each place,
the longest token that starts there and then shorter ones; a token stands only
if it is compatible with the one before it, that is, if merging the bytes of
both by rank gives back exactly these two (found by undoing their merges).  Compatibility is kept in a table,
and a place from which no token can stand is marked once, so a piece takes
time linear in its length.  The result is that of the merges by rank.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Encoded pieces that a worker keeps at once, twice; it bounds its memory and changes no result.
CACHE = 200_000
#: Longer pieces aren't kept.
CACHE_CHARS = 200
#: Bytes of text that are digested at once; a longer single text is digested by itself.
AT_ONCE = 1 << 22
#: Patterns of which no match holds a space after another character that isn't white space, and one starts at every space between two such characters.
APART = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: A word and marks after it, two matches (or one) of these patterns.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class _Kept(dict):
    """Results of a function of a string, for strings that aren't too long.

    When it is full, its entries become the older ones and what they still
    serve comes back from there, so at most twice ``CACHE`` entries are held.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, x: str):
        out = self.older.get(x)
        if out is None:
            out = self.make(x)
        if len(x) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[x] = out
        return out


class Encoder:
    """Encodes and decodes by the ranks of a vocabulary.

    ``pattern`` splits a text; each match is encoded by itself.  Every single
    byte must be in the vocabulary.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(_unicode_space(pattern)).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Kept(self.encode_match)
        self.apart_at_space = pattern in APART

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one (of two bytes at least)."""
        known = self.parts.get(token)
        if known is None:
            data, ranks = self.tokens[token], self.ranks
            for n in range(1, len(data)):
                a, b = ranks.get(data[:n]), ranks.get(data[n:])
                if a is not None and b is not None and self.apart(a, b, token):
                    known = self.parts[token] = a, b
                    break
            else:
                raise ValueError(f"rank {token} isn't made by a merge")
        return known

    def apart(self, a: int, b: int, before: int) -> bool:
        """Whether a and b, each whole, stay apart while the merges of rank below ``before`` are done.

        The merges are undone from the last: of the two tokens that meet at
        the border the one of higher rank was made later, so it is opened
        first.  A merge across the border of a lower rank would have come
        before it; of equal merges, the left one comes first.
        """
        tokens, ranks = self.tokens, self.ranks
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < before:
                return False
            made_a = a if len(tokens[a]) > 1 else -1
            made_b = b if len(tokens[b]) > 1 else -1
            if made_a > made_b:
                a, before = self.halves(a)[1], made_a
            elif made_b >= 0:
                b, before = self.halves(b)[0], made_b + 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of these two tokens is encoded as just them."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 4 * CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.apart(a, b, 1 << 60)
        return known

    def longest_at(self, data: bytes, text: str, at: int) -> int:
        """The longest token that starts here."""
        n = self.automaton.longest_prefix(text[at : at + self.longest])
        while (rank := self.ranks.get(data[at : at + n])) is None:
            n -= 1
        return rank

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.shorter[token] = next((r for n in range(len(data) - 1, 0, -1) if (r := self.ranks.get(data[:n])) is not None), -1)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size, sizes, text, pairs = len(data), self.sizes, data.decode("latin-1"), self.pairs
        closed = bytearray(size + 1)
        out: list[int] = []
        at, last, token = 0, -1, self.longest_at(data, text, 0)
        while at < size:
            while token >= 0:
                to = at + sizes[token]
                if not closed[to]:
                    if last < 0:
                        break
                    stands = pairs.get((last, token))
                    if self.compatible(last, token) if stands is None else stands:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, last = to, token
                token = self.longest_at(data, text, at) if at < size else -1
            else:
                if not out:
                    raise ValueError("the vocabulary's ranks aren't those of byte-pair merges")
                closed[at] = 1
                token = out.pop()
                at, last = at - sizes[token], out[-1] if out else -1
                token = self.next_shorter(token)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for piece in self.split(text) for i in self.encode_piece(piece.encode())]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_match(self, piece: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by commas, their number, and the decoded bytes of one match of the pattern."""
        ids = self.encode_piece(piece.encode())
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def count(self, text: str) -> int:
        """Number of ids of a whole text."""
        kept = self.pieces
        return sum([kept[x][1] for x in self.split(text)])

    def encode_unit(self, text: str) -> tuple[str, int, bytes]:
        """The same of a text; matches of the pattern recur, so most are looked up."""
        plain = self.apart_at_space and _PLAIN(text)
        if plain:
            word, marks = plain.groups()
            if not marks:
                return self.pieces[word]
            found = [self.pieces[word], self.pieces[marks]]
        else:
            found = [self.pieces[x] for x in self.split(text)]
        return ",".join([x[0] for x in found]), sum([x[1] for x in found]), b"".join([x[2] for x in found])

    def _units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the unit at each place, and the first place of each text and a last entry.

        A text is cut before each space between two characters that aren't
        white space, where a match of the pattern starts whatever is around.
        Other spaces stay inside a unit.
        """
        if not self.apart_at_space:
            return texts.to_pylist(), np.arange(len(texts)), np.arange(len(texts) + 1)
        split = pc.split_pattern(texts, " ")
        bound, words = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        code, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
        opens = np.array([x != "" and not x[0].isspace() for x in known], bool)
        closes = np.array([x != "" and not x[-1].isspace() for x in known], bool)
        starts = np.ones(len(code), bool)
        starts[1:] = opens[code[1:]] & closes[code[:-1]]
        starts[bound[:-1]] = True
        place = np.flatnonzero(starts)
        last = np.append(place[1:], len(code))
        unit, first = code[place], np.zeros(len(code), bool)
        first[bound[:-1]] = True
        units, more = [" " + x for x in known], {}
        for i in np.flatnonzero(first[place] | (last - place > 1)).tolist():
            lo, hi = place[i], last[i]
            text = ("" if first[lo] else " ") + " ".join([known[c] for c in code[lo:hi].tolist()])
            unit[i] = more.setdefault(text, len(known) + len(more))
        return units + list(more), unit, np.searchsorted(place, bound)

    def digests(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each text the number of ids, SHA-256 of the ids in decimal joined by commas, and of the decoded bytes; null counts as empty.

        Units of the texts recur, so each is encoded once here.
        """
        units, unit, bound = self._units(pc.fill_null(texts, ""))
        used, unit = np.unique(unit, return_inverse=True)
        found = [self.encode_unit(units[i]) for i in used.tolist()]
        n = np.cumsum(np.append(0, np.array([x[1] for x in found], np.int64)[unit]))
        ids, data = pa.array([x[0] for x in found], pa.large_string()), pa.array([x[2] for x in found], pa.large_binary())
        offsets, at = pa.array(bound, pa.int64()), pa.array(unit)
        joined = (pc.binary_join(pa.LargeListArray.from_arrays(offsets, x.take(at)), y) for x, y in ((ids, pa.scalar(",", pa.large_string())), (data, pa.scalar(b"", pa.large_binary()))))
        sha = (pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column]) for column in joined)
        return pa.array(np.diff(n[bound])), *sha


#: The code points with the property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _unicode_space(pattern: str) -> str:
    r"""\s and \S as the property White_Space, in or outside a set."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{_SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[:1] == "[" or inside and two[:1] != "]"
            out.append(two[:1])
            i -= 1
        i += 2
    return "".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    own = Encoder(read_ranks(path), pattern)
    gc.freeze()
    return own


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text as an array of ints.

    A null text counts as empty and has an empty array; rows repeat as they do
    in ``docs``; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.encode(x or "") for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data): the bytes of each array of ids; null counts as empty, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode_bytes(x or ()) for x in b.column(1).to_pylist()], pa.binary())], ["id", "data"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    One pass without a shuffle.  A null text counts as empty (0 tokens, the
    digest of no bytes); repeated rows stay; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            size, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), *own.digests(part.column(1))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at = to

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def count_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text; a null text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.count(x or "") for x in part.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
