"""Licence scans by a positional index of rare tokens.

The templates are word sequences with mandatory key phrases.  Of each
template's words the rarest in the corpus (highest IDF) are its look-up
words.  A text's occurrences of look-up words give postings (template, place
in the text less place in the template); a template is a candidate at a place
where the postings of its look-up words meet, and it is found there if its
key phrases stand where they must and enough of its words agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

WORDS = W.delimited("".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words_of(text: str) -> list[str]:
    """The words that a scan takes from a text."""
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    """A text, its label, and word ranges (first, last exclusive) that must agree word by word."""

    label: str
    text: str
    keys: tuple[tuple[int, int], ...] = ()
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)


#: Phrases that a base label stands for; each is a key phrase as a whole.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Usual licence notices, in words as the scan takes them, with the key phrase of each.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)


#: Label, key phrase and wording of licences and of the notices that stand in files.
TEXTS = (
    ("mit", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2", "binary form must reproduce the above copyright notice", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3", "may be used to endorse or promote products derived from this software", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("isc", "use copy modify and or distribute this software for any purpose with or without fee", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache-2", "you may not use this file except in compliance with the license", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2", "either version 2 of the license", """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl-3", "either version 3 of the license", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", "the terms of the gnu lesser general public license", """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl-3", "the terms of the gnu affero general public license", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("zlib", "the origin of this software must not be misrepresented", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("boost-1", "use reproduce display distribute execute and transmit the software", """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("unlicense", "free and unencumbered software released into the public domain", """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc0", "waived all copyright and related or neighboring rights", """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""),
    ("cc-by", "this work is licensed under a creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "creative commons attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def template(label: str, text: str, key: str) -> Template:
    """A template whose key phrase, which must stand in the text, is mandatory."""
    words, own = words_of(text), words_of(key)
    at = next(i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own)
    return Template(label, text, ((at, at + len(own)),))


def templates() -> list[Template]:
    """The base phrases, the short notices and the longer texts."""
    base = [Template(label, text, ((0, len(words_of(text))),), True) for text, label in BASE]
    return [*base, *(template(label, text, key) for label, text, key in NOTICES), *(template(label, text, key) for label, key, text in TEXTS)]


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows, and for each word of a fixed vocabulary the rows whose text has it; one pass over all texts."""
    hashes = np.array([W.hash_word(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(hashes), np.int64), 0
        for b in batches:
            rows += len(b)
            for part in W.words(b.column(0), WORDS, lower=True):
                at = np.minimum(np.searchsorted(hashes[order], part.hashes), len(hashes) - 1)
                hit = hashes[order][at] == part.hashes
                total += np.bincount(np.unique(part.doc[hit] * len(hashes) + order[at[hit]]) % len(hashes), minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(hashes))], pa.int32()), pa.array([rows, *total.tolist()], pa.int64())], ["word", "n"])

    counts = {r.word: r.n for r in docs.select(docs[text_col].alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.get(-1, 0), {w: counts.get(i, 0) for i, w in enumerate(vocabulary)}


@dataclass
class Index:
    """Hashed template words, the look-up words' places in the templates, and each word's IDF."""

    items: list[Template]
    hashed: list[np.ndarray]
    idf: list[np.ndarray]
    rare: np.ndarray
    postings: dict[int, list[tuple[int, int]]]
    need: list[int]

    @classmethod
    def build(cls, items: list[Template], rows: int, df: dict[str, int], lookups: int = 2) -> Index:
        hashed = [np.array([W.hash_word(w) for w in t.words], np.uint64) for t in items]
        idf = [np.array([np.log((rows + 1) / (df[w] + 1)) + 1 for w in t.words]) for t in items]
        postings: dict[int, list[tuple[int, int]]] = {}
        need = []
        for i, t in enumerate(items):
            inside = [j for a, b in t.keys for j in range(a, b)]
            chosen = sorted(inside, key=lambda j: (-idf[i][j], j))[:lookups]
            need.append(len(chosen))
            for j in chosen:
                postings.setdefault(int(hashed[i][j]), []).append((i, j))
        return cls(items, hashed, idf, np.array(sorted(postings), np.uint64), postings, need)

    def scan(self, part: W.Words, least: float) -> list[tuple[int, int, int, float]]:
        """(text, template, first word in the text, IDF-weighted agreement) of every place where a template is found."""
        out = []
        if not len(part.hashes) or not len(self.rare):
            return out
        at = np.minimum(np.searchsorted(self.rare, part.hashes), len(self.rare) - 1)
        places = np.flatnonzero(self.rare[at] == part.hashes)
        met: dict[tuple[int, int], int] = {}
        for p in places.tolist():
            for i, j in self.postings[int(part.hashes[p])]:
                met[i, p - j] = met.get((i, p - j), 0) + 1
        for (i, first), n in met.items():
            if n < self.need[i]:
                continue
            own, doc = self.hashed[i], part.doc[first + self.items[i].keys[0][0]]
            lo, hi = int(part.bound[doc]), int(part.bound[doc + 1])
            if any(first + a < lo or first + b > hi or (part.hashes[first + a : first + b] != own[a:b]).any() for a, b in self.items[i].keys):
                continue
            if any(part.word(first + j) != self.items[i].words[j].encode() for a, b in self.items[i].keys for j in range(a, b)):
                continue
            a, b = max(first, lo), min(first + len(own), hi)
            same = part.hashes[a:b] == own[a - first : b - first]
            agreement = float(self.idf[i][a - first : b - first][same].sum() / self.idf[i].sum())
            if agreement >= least:
                out.append((int(doc), i, first - lo, agreement))
        return out


def scan_documents(docs: DataFrame, items: list[Template] | None = None, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Words are runs of a-z, 0-9 and non-ASCII characters, A-Z in lower case;
    they count from 0.  ``n_base`` counts all places of base phrases and
    first_word and last_word are their smallest and largest start; labels also
    has those of notices that agree to ``least`` by IDF, and score is the best
    agreement (1 for a base phrase, 0 if nothing is found).  A null text is
    empty; empty label sets are ''; repeated rows stay; no shuffle of texts.
    Document frequencies come from a pass of their own over all rows.
    """
    items = templates() if items is None else items
    vocabulary = sorted({w for t in items for w in t.words})
    index = Index.build(items, *document_frequencies(docs, vocabulary, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in W.words(b.column(1), WORDS, lower=True):
                n = part.n
                count, first, last = [0] * n, [None] * n, [None] * n
                base, every, score = [set() for _ in range(n)], [set() for _ in range(n)], [0.0] * n
                for doc, i, at, agreement in index.scan(part, least):
                    t = items[i]
                    every[doc].add(t.label)
                    score[doc] = max(score[doc], min(1.0, agreement))
                    if t.base:
                        base[doc].add(t.label)
                        count[doc] += 1
                        first[doc] = at if first[doc] is None else min(first[doc], at)
                        last[doc] = at if last[doc] is None else max(last[doc], at)
                text = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.first, n), pa.array(np.diff(part.bound), pa.int64()), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), text(base), text(every), pa.array(score, pa.float64())], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)
