"""License scans with a generalised suffix automaton.

The automaton holds every run of words of every template: whole licences, and the notices and statements that name one. A
file is streamed through it word by word: the matching statistics tell, at each word, the longest run ending there that
some template has. Runs of MIN_MATCH words or more that cannot be extended are placed in their templates and chained. A run
may have several places in a template; each place continues the chain that covers most of those that it can continue in
both texts, with at most GAP words between, or begins one, and the chains that it does not continue stay open. So neither
filled-in names and dates nor another place of a run break a chain. A chain that covers COVERED of its template (NAMED of
one of fewer than SHORT words, where a word tells licences apart) is a span with the template's label. Of spans that
overlap by half or more, the one that covers most words stays. Words outside the templates' vocabulary cannot belong to a
run, so only stretches of vocabulary words are streamed.

Null and empty texts have no words. Texts are taken whole. Rows stand alone, so ties and repeated rows change nothing;
additional columns travel along, but for columns named n_words, license_base and license_spans, which are replaced. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docengine.llm.common import small

MIN_MATCH, GAP, COVERED, NAMED, SHORT = 3, 12, 0.6, 0.9, 20
#: Base phrases and their labels (fixed values).
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))
#: License notices and their labels (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "Copyright. All rights reserved."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)
#: Files beside this module with whole licences (fixed values), and their labels.
WHOLE = (("apache-2.0", "apache-2.0"), ("artistic", "artistic"), ("cc0", "cc0"), ("gpl", "gpl-2"), ("gpl", "gpl-3"), ("lgpl", "lgpl-2.1"), ("lgpl", "lgpl-3"), ("mpl-2.0", "mpl-2.0"))


def templates() -> tuple[tuple[str, str], ...]:
    """All templates, read on the driver: executors need not have the files."""
    texts = resources.files("docengine.llm") / "license_texts"
    return TEMPLATES + tuple((label, (texts / f"{name}.txt").read_text(encoding="utf-8")) for label, name in WHOLE)

#: Every byte but those of words becomes a blank; A-Z become lower case; bytes of other characters belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton of word ids, with the places of each state's runs."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(templates):
            at = 0
            for i, x in enumerate(ids):
                at = self._extend(at, x)
                ends.setdefault(at, []).append((t, i + 1))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # a state's runs also end wherever those of the states below it in the link tree end
            if self.link[s] > 0:
                ends.setdefault(self.link[s], []).extend(ends[s])
        self.ends = [ends.get(s, []) for s in range(len(self.next))]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        """The part of q whose runs are no longer than those of p and one word, as a state of its own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if (q := self.next[last].get(x)) is not None:  # an earlier template has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def matches(self, ids, offset: int = 0) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of the runs of MIN_MATCH words or more that cannot be extended to the right and are longest to the left."""
        state, have, before = 0, 0, (0, 0)
        for i, x in enumerate(ids):
            while state and x not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if x in self.next[state]:
                state, have = self.next[state][x], have + 1
            else:
                state = have = 0
            if have != before[0] + 1 and before[0] >= MIN_MATCH:
                yield offset + i - before[0], offset + i, before[1]
            before = (have, state)
        if before[0] >= MIN_MATCH:
            n = offset + len(ids)
            yield n - before[0], n, before[1]


class Scanner:
    def __init__(self, given=None):
        cut = [(label, words(text)) for label, text in (templates() if given is None else given)]
        self.vocab: dict[bytes, int] = {}
        for _, ws in [*cut, *(("", phrase.split()) for phrase, _ in BASE)]:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.labels = [label for label, _ in cut]
        ids = [[self.vocab[w] for w in ws] for _, ws in cut]
        self.sizes = [len(x) for x in ids]
        self.automaton = Automaton(ids)
        self.base = [([self.vocab[w] for w in phrase.split()], label) for phrase, label in BASE]

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of the chains that cover enough of their template."""
        known = np.flatnonzero(ids)
        if len(known) < MIN_MATCH:
            return []
        cuts = np.flatnonzero(np.diff(known) > 1)
        firsts, lasts = known[np.r_[0, cuts + 1]], known[np.r_[cuts, len(known) - 1]]
        long = lasts - firsts + 1 >= MIN_MATCH
        # by template: start and end in the text, end in the template, words covered
        chains: dict[int, list[tuple[int, int, int, int]]] = {}
        out: list[tuple[int, int, int, int]] = []

        def enough(t: int, covered: int, length: int) -> bool:
            if self.sizes[t] < SHORT:  # another word in it may name another licence
                return covered >= NAMED * self.sizes[t] and length <= covered
            return covered >= COVERED * self.sizes[t]

        for a, b in zip(firsts[long].tolist(), lasts[long].tolist()):
            for start, end, state in self.automaton.matches(ids[a : b + 1].tolist(), a):
                places: dict[int, list[int]] = {}
                for t, stop in self.automaton.ends[state]:
                    places.setdefault(t, []).append(stop)
                for t, stops in places.items():
                    alive = [c for c in chains.get(t, ()) if start - c[1] <= GAP]
                    best = {c[2]: c for c in sorted(alive, key=lambda c: c[3])}  # of chains that end alike, the longest
                    for stop in stops:
                        begin = stop - (end - start)
                        found = max(((c[3] + stop - max(begin, c[2]), -c[0]) for c in alive if stop > c[2] and begin - c[2] <= GAP), default=(0, 0))
                        covered, first = (found[0], -found[1]) if found[0] > end - start else (end - start, start)
                        if stop not in best or best[stop][3] <= covered:
                            best[stop] = (first, end, stop, covered)
                            if enough(t, covered, end - first):
                                out.append((t, first, end, covered))
                    chains[t] = list(best.values())
        kept: list[tuple[int, int, int, int]] = []
        for t, start, end, covered in sorted(set(out), key=lambda c: (-c[3], c[2] - c[1], c)):
            if all(2 * (min(end, e) - max(start, s)) < min(end - start, e - s) for _, s, e, _ in kept):
                kept.append((t, start, end, covered))
        spans = {(self.labels[t], start, end, min(covered / self.sizes[t], 1.0)) for t, start, end, covered in kept}
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words, places (label, start) of the base phrases, spans."""
        ws = words(text)
        ids = np.fromiter(map(self.vocab.get, ws, repeat(0)), np.int32, len(ws))
        places = []
        for phrase, label in self.base:
            hit = np.ones(max(len(ids) - len(phrase) + 1, 0), bool)
            for k, x in enumerate(phrase):
                hit &= ids[k : len(ids) - len(phrase) + 1 + k] == x
            places += [(label, int(i)) for i in np.flatnonzero(hit)]
        return len(ws), sorted(places, key=lambda p: p[1]), self.spans(ids)


_scanner: list[Scanner] = []
COLUMNS = ("n_words", "license_base", "license_spans")
_PLACE, _SPAN = pa.struct([("label", pa.string()), ("start", pa.int64())]), pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and n_words, license_base (label, start), license_spans (label, start, end, covered)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in COLUMNS]
    needed = list(dict.fromkeys([*keep, text]))
    source = df.select(*(f"`{c}`" for c in needed))

    given = df.sparkSession.sparkContext.broadcast(templates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner(given.value))
        for b in small(batches):
            rows = [_scanner[0].scan(t.as_py()) for t in b.column(needed.index(text))]
            out = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"label": p[0], "start": p[1]} for p in r[1]] for r in rows], pa.list_(_PLACE)),
                pa.array([[{"label": s[0], "start": s[1], "end": s[2], "covered": s[3]} for s in r[2]] for r in rows], pa.list_(_SPAN)),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(needed.index(c)) for c in keep), *out], [*keep, *COLUMNS])

    kinds = "n_words long, license_base array<struct<label:string,start:long>>, license_spans array<struct<label:string,start:long,end:long,covered:double>>"
    return source.mapInArrow(run, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep) + kinds)


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and labels; the score is the largest covered share of a template, a base phrase being one that is covered whole."""
    return scanned.selectExpr(
        f"`{key}`",
        "n_words",
        "cast(size(license_base) as long) as n_base",
        "array_min(license_base.start) as first_word",
        "array_max(license_base.start) as last_word",
        "array_join(array_sort(array_distinct(license_base.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(license_base.label, license_spans.label))), ',') as labels",
        "case when size(license_base) > 0 then 1D else coalesce(array_max(license_spans.covered), 0D) end as score",
    )
