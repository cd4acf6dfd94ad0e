"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates. A text is streamed through it, which gives at each
word the longest run ending there that stands in a template (the matching statistics). Runs of LONG
words or more that cannot be prolonged are chained, in the order of the template and with at most GAP other
words between them; a template is found where a chain covers SHARE of it. Base phrases are
templates too, whose places are counted wherever they stand in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm.common import map_batches, table

LONG, GAP, SHARE = 4, 12, 0.6

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels and wordings of public licences, whole where they are short, and of their notices and grants.
_AS_IS = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd", _BSD),
    ("bsd-2-clause", f"{_BSD} {_AS_IS}"),
    ("bsd-3-clause", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc", "licensed under a creative commons attribution"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
]
#: Words too common to start a look at a text; every LONG words of a template, and every phrase, hold another one.
COMMON = set("a an and any are be by for form from in is it no not of on or out that the this to use with you above under".split())

#: A-Z to lower case, and all other ASCII characters but digits and letters to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton over word sequences, with the places of its states in the templates.

    A state's strings end where those of the states below it in the tree of suffix links do: walked in order, these
    are neighbours, so all places are one list and a state has a range of it.
    """

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, words in enumerate(sequences):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                places[last].append((number, k + 1))
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self.ends: list[tuple[int, int]] = []  # (template, end)
        self.first, self.last = [0] * len(self.next), [0] * len(self.next)
        waiting = [(0, False)]
        while waiting:
            state, left = waiting.pop()
            if left:
                self.last[state] = len(self.ends)
                continue
            self.first[state] = len(self.ends)
            self.ends += places.get(state, [])
            waiting.append((state, True))
            waiting += [(s, False) for s in below[state]]

    def places(self, state: int) -> list[tuple[int, int]]:
        """(template, end) of the strings of a state."""
        return self.ends[self.first[state] : self.last[state]]

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._add(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new, p = self._add(self.length[last] + 1), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the longest suffix that stands in a template."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        self.labels = [*phrases.values(), *[label for label, _ in templates]]
        self.sizes = [len(words_of(t)) for t in [*phrases, *[t for _, t in templates]]]
        self.phrases = len(phrases)
        sequences = [words_of(t) for t in [*phrases, *[t for _, t in templates]]]
        self.automaton = Automaton(sequences)
        common = {w.encode() for w in COMMON}
        self.vocabulary = {w for s in sequences for w in s}
        self.rare = self.vocabulary - common
        for s in sequences:  # each phrase and each long match then holds a rare word
            for k in range(len(s) - min(LONG, len(s)) + 1):
                if self.rare.isdisjoint(s[k : k + LONG]):
                    self.rare.add(max(s[k : k + LONG], key=lambda w: (len(w), w)))
        #: For each state the phrases that its strings end with, and their lengths: those of its suffix link and its own.
        self.full: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for p in range(self.phrases):
            state = 0
            for word in sequences[p]:
                state = self.automaton.next[state][word]
            self.full[state].append((p, self.sizes[p]))
        for state in sorted(range(1, len(self.full)), key=lambda s: self.automaton.length[s]):
            self.full[state] = self.full[state] + self.full[self.automaton.link[state]]

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Runs of words of the vocabulary with a rare word: (start, end)."""
        rare, vocabulary, end = self.rare, self.vocabulary, 0
        for k, word in enumerate(words):
            if k >= end and word in rare:
                start = k
                while start > end and words[start - 1] in vocabulary:
                    start -= 1
                end = k + 1
                while end < len(words) and words[end] in vocabulary:
                    end += 1
                yield start, end

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end) of a text."""
        words = words_of(text)
        if self.rare.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, []
        base: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, end in self.runs(words):
            before = (0, 0)
            for k, now in enumerate([*self.automaton.stream(words[start:end]), (0, 0)], start):
                if k < end:
                    base += [(k + 1 - size, p) for p, size in self.full[now[0]] if size <= now[1]]
                if before[1] >= LONG and now[1] <= before[1]:
                    for p, at in self.automaton.places(before[0]):
                        if p >= self.phrases and at >= before[1]:
                            matches[p].append((k - before[1], at - before[1], before[1]))
                before = now
        score, spans = 0.0, []
        for p, found in matches.items():
            covered = self.chained(found, self.sizes[p])
            score = max(score, covered[0])
            if covered[0] >= SHARE:
                spans.append((self.labels[p], covered[1], covered[2]))
        starts = [s for s, _ in base]
        names = {self.labels[p] for _, p in base}
        if base:
            score = 1.0
        every = names | {s[0] for s in spans}
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(every)), float(score), sorted(set(spans))

    @staticmethod
    def chained(found: list[tuple[int, int, int]], size: int) -> tuple[float, int, int]:
        """(share covered, start, end) of the best chain of matches (start, start in the template, length).

        Matches are taken by their start; each goes on the best chain whose end lies at most GAP words back,
        in the order of the template. Only chains that end within reach are looked at.
        """
        best, open_ = (0.0, 0, 0), []
        for start, at, length in sorted(set(found)):
            open_ = [c for c in open_ if c[1] + GAP >= start]
            chain = (length, start + length, at + length, start)
            for covered, end, end_at, first in open_:
                fresh = min(start + length - max(start, end), at + length - max(at, end_at))
                if fresh > 0 and end_at < at + length and end < start + length and covered + fresh > chain[0]:
                    chain = (covered + fresh, start + length, at + length, first)
            open_.append(chain)
            best = max(best, (min(1.0, chain[0] / size), chain[3], chain[1]))
        return best


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(list(templates), dict(phrases))


def templates_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Templates from a folder of licence texts, the file's name without ending being the label: for licences too long to be listed here."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()  # a few hundred files at most
    return sorted((r.name.rsplit(".", 1)[0].lower(), r.value) for r in rows)


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of documents (doc_id, text): counts, labels, score and covered spans.

    Null text: empty, no words, no labels, score 0. Repeated rows, and rows without a doc_id, are each
    scanned. The score is 1 where a base phrase stands, else the largest share of a template that a
    chain covers. Extra columns are not read.
    """
    key = tuple(templates), tuple(phrases.items())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns[7] = [[{"label": s[0], "start": s[1], "end": s[2]} for s in x] for x in columns[7]]
        yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op5_licenses": op5_licenses}
ORACLES: dict[str, str] = {}
