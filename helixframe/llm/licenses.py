"""License scans with a positional index of rare words.

Every template is a word sequence with a mandatory key phrase: whole licence texts
and notices, and the names that licences go by. Document frequencies of all
template words are counted over the whole corpus, so what is rare in this corpus
leads the search.

*Texts.* The index holds, for each template, the places of its ``POSTED`` rarest words, wherever in the
template they stand. In a file, each place of such a word minus its offset is a vote for where the template
starts. Votes of a third of the posted words within a band (a quarter of the template's
length, so that inserted, missing and changed words are followed) make a candidate. It is verified by
aligning the template freely with that stretch of the file (longest common subsequence of words): at least ``COVERAGE`` of its
words have to stand there in order, and of the key phrase all words but one (all of a phrase under five).

*Names and base phrases* are templates of nothing but their key phrase: the places of its words, rarest first, minus
their offsets are intersected one word after another, so every place is found.

An alignment's score is its coverage (matching words of the template's) times m / (m + 1) for m
matching words, so that a name counts less than a whole text.

Defined results: a null or empty text has no words, no labels (empty strings),
null places and score 0; overlapping places all count; a text's score is the
largest among its verified alignments. Repeated rows get equal results; null ids
stay null; other columns are ignored. Of a very long text a task holds its words
and the places of the few that are in the index.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, small_batches, utf8

#: The base phrases; whole texts and notices with the key phrase that must stand in a file; names.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "unlicense",
        "free and unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    (
        "zlib",
        "without any express or implied warranty in no event will the authors be held liable",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
    ),
    (
        "bsl",
        "boost software license",
        """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
        permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    ),
    (
        "apache",
        "licensed under the apache license",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    (
        "gpl",
        "under the terms of the gnu general public license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    (
        "lgpl",
        "under the terms of the gnu lesser general public license",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "agpl",
        "under the terms of the gnu affero general public license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    ),
    (
        "mpl",
        "subject to the terms of the mozilla public license",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
)
NAMES = (
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsl", "boost software license"),
    ("cc0", "cc0 1 0"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution"),
    ("all-rights-reserved", "all rights reserved"),
)


POSTED = 12
COVERAGE = 0.7
#: Words of the three-clause text that the two-clause one doesn't have, first and last.
CLAUSE = (b"3 neither the name of the copyright holder", b"specific prior written permission")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    base: bool = False

    @property
    def whole(self) -> bool:
        """Whether there is more than the key phrase."""
        return len(self.words) > len(self.key)


def templates() -> list[Template]:
    out = [Template(label, tuple(alnum_words(x.encode())), tuple(alnum_words(x.encode())), base) for base, names in ((True, BASE), (False, NAMES)) for label, x in names]
    for label, phrase, text in TEXTS:
        words, key = alnum_words(text.encode()), tuple(alnum_words(phrase.encode()))
        out.append(Template(label, tuple(words), key))
        first, last = (x.split() for x in CLAUSE)
        for i in range(len(words)):
            if words[i : i + len(first)] == first:
                stop = next(j for j in range(i, len(words)) if words[j : j + len(last)] == last) + len(last)
                out.append(Template(label, tuple(words[:i] + words[stop:]), key))
    return out


class Order:
    """Longest common subsequences with one word sequence, a bit a word."""

    def __init__(self, words: tuple[bytes, ...]):
        self.size = len(words)
        self.bits: dict[bytes, int] = defaultdict(int)
        for i, w in enumerate(words):
            self.bits[w] |= 1 << i

    def common(self, text: list[bytes]) -> int:
        full = (1 << self.size) - 1
        row = full
        for w in text:
            if hit := self.bits.get(w):
                new = row & hit
                row = ((row + new) | (row - new)) & full
        return self.size - row.bit_count()


class Index:
    """Places of words in templates: of names all words, rarest first; of texts the rarest ones that the corpus has."""

    def __init__(self, frequency: dict[bytes, int]):
        self.rarity = frequency
        self.names = [t for t in templates() if not t.whole]
        # a text can't be found where the corpus, or below the file, lacks more of its words than may be missing
        self.texts = [t for t in templates() if t.whole and sum(frequency.get(w, 0) > 0 for w in t.words) >= COVERAGE * len(t.words)]
        self.counts = [Counter(t.words) for t in self.texts]
        rare = lambda w: (frequency.get(w, 0), w)
        self.postings = [sorted(((w, i) for i, w in enumerate(t.key)), key=lambda x: (*rare(x[0]), x[1])) for t in self.names]
        self.leads: dict[bytes, list[int]] = defaultdict(list)
        for k, posting in enumerate(self.postings):
            self.leads[posting[0][0]].append(k)
        self.posted: list[dict[bytes, list[int]]] = []
        for t in self.texts:
            chosen = sorted((w for w in set(t.words) if frequency.get(w, 0)), key=rare)[:POSTED]
            self.posted.append({w: [i for i, x in enumerate(t.words) if x == w] for w in chosen})
        self.orders = [(Order(t.words), Order(t.key)) for t in self.texts]
        self.known = {w for t in self.names for w in t.key} | {w for posted in self.posted for w in posted}

    def alignments(self, words: list[bytes]) -> Iterator[tuple[Template, int, float]]:
        """Verified alignments: template, start of its first word (below 0 where the text begins later), score."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.known:
                places[w].append(i)
        if places:
            yield from self._named(words, places)
            yield from self._aligned(words, places)

    def _named(self, words: list[bytes], places: dict[bytes, list[int]]) -> Iterator[tuple[Template, int, float]]:
        for lead in sorted(self.leads.keys() & places.keys(), key=lambda w: (self.rarity.get(w, 0), w)):
            for k in self.leads[lead]:
                t, starts = self.names[k], None
                for word, offset in self.postings[k]:
                    mine = {p - offset for p in places[word]} if word in places else set()
                    starts = mine if starts is None else starts & mine
                    if not starts:
                        break
                for start in sorted(starts):
                    if tuple(words[start : start + len(t.key)]) == t.key:
                        yield t, start, len(t.key) / (len(t.key) + 1)

    def _aligned(self, words: list[bytes], places: dict[bytes, list[int]]) -> Iterator[tuple[Template, int, float]]:
        have = set(words)
        for t, posted, count, (order, key) in zip(self.texts, self.posted, self.counts, self.orders, strict=True):
            need = max(2, -(-len(posted) // 3))
            if sum(w in places for w in posted) < need or sum(n for w, n in count.items() if w in have) < COVERAGE * len(t.words):
                continue
            votes = sorted((p - i, w) for w, offsets in posted.items() for p in places.get(w, ()) for i in offsets)
            band, size = max(10, len(t.words) // 4), len(t.words)
            for first, last in _bands(votes, band, need):
                stretch = words[max(0, first - band) : max(0, last + size + band)]
                same = order.common(stretch)
                if same >= COVERAGE * size and key.common(stretch) >= len(t.key) - (len(t.key) >= 5):
                    yield t, first, same / size * same / (same + 1)


def _bands(votes: list[tuple[int, bytes]], band: int, need: int) -> Iterator[tuple[int, int]]:
    """Stretches of sorted votes, each of no more than ``band``, with ``need`` different words; the fullest first where they overlap."""
    held: Counter[bytes] = Counter()
    found, at = [], 0
    for k, (vote, word) in enumerate(votes):
        held[word] += 1
        while votes[at][0] < vote - band:
            held[votes[at][1]] -= 1
            if not held[votes[at][1]]:
                del held[votes[at][1]]
            at += 1
        if len(held) >= need:
            found.append((-len(held), votes[at][0], votes[k][0]))
    taken: list[tuple[int, int]] = []
    starts: list[int] = []
    for _, first, last in sorted(found):
        # bands that are taken don't overlap, so their order by start is their order by end
        k = bisect_left(starts, first)
        if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or last < taken[k][0]):
            taken.insert(k, (first, last))
            starts.insert(k, first)
    yield from taken


def frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Documents that have each template word, over all documents; as many rows as the templates have words."""
    small_batches(docs.sparkSession)
    vocabulary = {w for t in templates() for w in t.words}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in utf8(batch["text"]):
                found.update(vocabulary.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,score:double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))


def licenses(docs: DataFrame, frequency: dict[bytes, int] | None = None) -> DataFrame:
    """Per row: base places and labels, the method's labels, score and all verified alignments with their first word."""
    small_batches(docs.sparkSession)
    index = Index(frequencies(docs) if frequency is None else frequency)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in utf8(batch["text"]):
                words = alnum_words(text)
                found = sorted(index.alignments(words), key=lambda x: (x[1], x[0].label, x[2]))
                base = [(t, s) for t, s, _ in found if t.base]
                for column, value in zip(
                    columns,
                    (
                        len(words),
                        len(base),
                        min((s for _, s in base), default=None),
                        max((s for _, s in base), default=None),
                        ",".join(sorted({t.label for t, _ in base})),
                        ",".join(sorted({t.label for t, _, _ in found})),
                        max((c for _, _, c in found), default=0.0),
                        [{"label": t.label, "start": s, "score": c} for t, s, c in found],
                    ),
                    strict=True,
                ):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
