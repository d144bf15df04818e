"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton of all templates is built once per worker; a file streams through it word by word and yields matching
statistics: the longest run of words, ending here, that stands in some template. Maximal long runs are chained, in the order
of file and template, into spans that cover a template; a span that covers enough of it gives the template's label. Phrases of
fixed labels are templates too, found at every place through the automaton's suffix links.

Scale: map only, no shuffle, linear in the text; the automaton has at most twice as many states as the templates have words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Runs shorter than this aren't chained (a shorter template must match as a whole).
MIN_RUN = 4
#: Words of the file that may stand between chained runs.
MAX_GAP = 12
#: A template's label needs this share of its words covered by one chain.
MIN_COVER = 0.7

# Phrases with their labels, and templates of public licences and their notices.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl-3.0",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation",
        "lgpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at",
        "mpl-2.0",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be "
        "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        "bsd",
    ),
    (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
        "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
        "the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
        "product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or "
        "altered from any source distribution",
        "zlib",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and "
        "to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        "bsl-1.0",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
        "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial "
        "and by any means",
        "unlicense",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version",
        "gpl-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
        "agpl-3.0",
    ),
    (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "cc0-1.0",
    ),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
    (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "epl",
    ),
]
# End of fixed values.

#: Bytes to words: A-Z lower-cased, what isn't 0-9, a-z or beyond ASCII to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences. next[s]: transitions by word; link[s]: suffix link; length[s]: longest word
    run of the state; ends[s]: (template, end) of the places where the state's runs end; phrases[s]: phrases that are suffixes of
    its longest run, as (phrase, length)."""

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)

    def _new(self, like: int | None, length: int) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the runs of p followed by word: q, or a copy of it for the shorter runs."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(q, self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        state, p = self._new(None, self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        self.link[state] = 0 if p < 0 else self._split(p, word, self.next[p][word])
        return state

    def step(self, state: int, n: int, word: bytes) -> tuple[int, int]:
        """Matching statistics after one more word of a file."""
        while state and word not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, n + 1)


def build(templates: list[list[bytes]], phrases: list[list[bytes]]) -> Automaton:
    a = Automaton()
    for t in [*templates, *phrases]:
        last = 0
        for w in t:
            last = a.extend(last, w)
    for k, t in enumerate(templates):
        s = 0
        for i, w in enumerate(t):
            s = a.next[s][w]
            up = s
            while up > 0:
                a.ends[up].append((k, i + 1))
                up = a.link[up]
    at: dict[int, list[tuple[int, int]]] = {}
    for k, p in enumerate(phrases):
        s = 0
        for w in p:
            s = a.next[s][w]
        at.setdefault(s, []).append((k, len(p)))
    for s in range(len(a.next)):
        found, up = [], s
        while up > 0:
            found += at.get(up, [])
            up = a.link[up]
        a.phrases.append(found)
    return a


class Scanner:
    """Finds phrases and template spans in files."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for _, label in templates]
        self.lengths = [len(words_of(t)) for t, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        self.automaton = build([words_of(t) for t, _ in templates], [words_of(p) for p, _ in phrases])
        self.shortest = min([MIN_RUN, *self.lengths])

    def scan(self, words: list[bytes]):
        """(places, spans): places are (first word, phrase); spans (first word, end word, template, words covered)."""
        a, known = self.automaton, self.automaton.next[0]
        places, runs = [], []
        state = n = 0
        inside = [i for i, w in enumerate(words) if w in known]
        before = -2
        for i in inside:
            if i != before + 1:
                if n >= self.shortest:
                    runs.append((before + 1, n, state))
                state = n = 0
            was, m = state, n
            state, n = a.step(state, n, words[i])
            if n <= m and m >= self.shortest:
                runs.append((i, m, was))
            for k, size in a.phrases[state]:
                if size <= n:
                    places.append((i + 1 - size, k))
            before = i
        if n >= self.shortest:
            runs.append((before + 1, n, state))
        return places, self.best(self.chain(runs))

    def best(self, spans: list[tuple[int, int, int, int]]):
        """Without the spans that share over half of their words with one that covers more of its template: licences that differ in
        a version number or a name match each other's notices for the rest. Chains of one template never overlap, so each span
        is held against as many as there are templates at most."""
        lost, open_ = set(), []
        for j, (first, end, k, covered) in enumerate(spans):
            open_ = [i for i in open_ if spans[i][1] > first]
            for i in open_:
                shared, other = min(end, spans[i][1]) - first, spans[i]
                mine, its = covered * self.lengths[other[2]], other[3] * self.lengths[k]
                if mine > its and 2 * shared > other[1] - other[0]:
                    lost.add(i)
                elif mine < its and 2 * shared > end - first:
                    lost.add(j)
            open_.append(j)
        return [x for j, x in enumerate(spans) if j not in lost]

    def chain(self, runs: list[tuple[int, int, int]]):
        """runs: (end word, length, state), in order. Chains each template's runs while the file's gap is small and the
        template moves on; closed chains that cover enough become spans."""
        open_: dict[int, list[int]] = {}  # template: first word, end word, end in template, words covered
        spans = []

        def close(k: int) -> None:
            first, end, _, covered = open_.pop(k)
            if covered >= MIN_COVER * self.lengths[k]:
                spans.append((first, end, k, covered))

        for end, n, state in runs:
            best: dict[int, int] = {}
            for k, e in self.automaton.ends[state]:
                if n >= min(MIN_RUN, self.lengths[k]):
                    here = open_.get(k)
                    fits = here is not None and end - n - here[1] <= MAX_GAP and e > here[2] and end > here[1]
                    # the nearest place after the chain; without one, the first
                    if k not in best or fits and not (here[2] < best[k]):
                        best[k] = e
            for k, e in best.items():
                here = open_.get(k)
                if here is not None and end - n - here[1] <= MAX_GAP and e > here[2] and end > here[1]:
                    here[3] += min(n, end - here[1], e - here[2])
                    here[1], here[2] = end, e
                else:
                    if here is not None:
                        close(k)
                    open_[k] = [end - n, end, e, n]
        for k in list(open_):
            close(k)
        return sorted(spans)


_scanners: dict[str, Scanner] = {}


def scanned(batches):
    """Arrow batches of (key columns..., text) to (key columns..., what a scan found)."""
    if not _scanners:
        _scanners["default"] = Scanner()
    s = _scanners["default"]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for batch in batches:
        n, out = batch.num_columns - 1, []
        for t in batch.column(n):
            words = words_of(t.as_py())
            places, spans = s.scan(words)
            base = {s.phrase_labels[k] for _, k in places}
            score = max([1.0 if places else 0.0, *(min(1.0, c / s.lengths[k]) for *_, k, c in spans)])
            starts = [p for p, _ in places]
            out.append((
                len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {s.labels[k] for *_, k, _ in spans})), score,
                [{"first_word": f, "end_word": e, "label": s.labels[k], "covered": c} for f, e, k, c in spans],
            ))
        span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("covered", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *cols], [*batch.schema.names[:-1], *names])


def licence_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, plus n_words, n_base, first_word, last_word (null without a place), base_labels, labels (empty
    strings without any), score (best share of a template or phrase covered) and spans (word ranges with label and words
    covered). A null text counts as empty. Each row is scanned by itself, repeated ones too; an empty table gives no rows; columns
    of docs with these names are replaced, others stay."""
    names = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"}
    keys = [c for c in docs.columns if c != text and c not in names]
    rows = docs.select(*(f"`{c}`" for c in keys), f"`{text}`")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
        + ["n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"]
        + ["spans array<struct<first_word: long, end_word: long, label: string, covered: long>>"]
    )
    return rows.mapInArrow(common.on_workers(__name__, "scanned"), schema)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return licence_scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans").selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
