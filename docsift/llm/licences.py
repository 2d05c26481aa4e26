"""Licence scan: matching statistics from a suffix automaton of licence wordings.

A generalised suffix automaton holds every run of words of every template. A text is
streamed through it: after each word the state tells the longest run of words ending
there that some template has. A run that cannot be continued is a match; long matches
of one template are chained in order, and what part of the template they cover decides
on its label. Of wordings that overlap, the one that covers more stays. Apart from that,
the base phrases are found wherever their words stand consecutively.

The score grades the evidence: the greatest share of a wording that is covered, and
``MENTION`` for a base phrase, put together as independent grounds.

Words are runs of letters and digits as ``WORD`` has them, after lower-casing A-Z.

Defined results: null counts as empty, which has no words, labels or places and score 0;
repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short wordings of well-known licences, each with the label that it proves.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-notice": "Released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-text": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for"
        " the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
        " distribution."
    ),
    "cc-by-4.0-notice": "licensed under CC BY 4.0",
    "cc-by-nc-4.0-notice": "licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": "licensed under CC BY-SA 4.0",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "as-is-text": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
        " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-3-clause-text": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission."
    ),
    "apache-2.0-header-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-2.0-text": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later"
        " version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "agpl-3.0-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        " the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "lgpl-2.1-text": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)"
        " any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "mpl-2.0-text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
        " for any damages arising from the use of this software. Permission is granted to anyone to use this software for any"
        " purpose, including commercial applications, and to alter it and redistribute it freely."
    ),
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "lgpl-3.0-notice": "licensed under the GNU Lesser General Public License, version 3",
    "agpl-3.0-notice": "licensed under the GNU Affero General Public License, version 3",
    "cc0-1.0-notice": "dedicated to the public domain under CC0 1.0",
}
#: Words of a match that is chained, share of a template that its chain must cover, and
#: words that may stand between two matches of a chain.
LEAST_MATCH, LEAST_COVER, LARGEST_GAP = 4, 0.8, 12
#: What a base phrase alone adds to the score: it may be mentioned without being granted.
MENTION = 0.5
#: Words looked at together.
BLOCK = 1 << 18


def _fold() -> bytes:
    table = bytearray(b" " * 256)
    for b in range(256):
        if re.fullmatch(WORD, bytes([b]).lower()):
            table[b] = bytes([b]).lower()[0]
    return bytes(table)


FOLD = _fold()


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton; each state knows where in which templates it ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, symbol)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def add(self, template: int, symbols: list[int]) -> None:
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)

    def finish(self, templates: list[list[int]]) -> None:
        """Note at every state where its runs end."""
        for t, symbols in enumerate(templates):
            state = 0
            for i, symbol in enumerate(symbols):
                state = at = self.next[state][symbol]
                while at > 0:
                    self.ends[at].setdefault(t, []).append(i)
                    at = self.link[at]

    def matches(self, symbols: list[int], least: int) -> list[tuple[int, int, int]]:
        """(first, stop, state) of each run of at least ``least`` symbols that cannot go on."""
        out = []
        state = size = 0
        following, link, length = self.next, self.link, self.length
        for i, symbol in enumerate(symbols):
            if symbol in following[state]:
                state = following[state][symbol]
                size += 1
                continue
            if size >= least:
                out.append((i - size, i, state))
            while state >= 0 and symbol not in following[state]:
                state = link[state]
            if state < 0:
                state = size = 0
            else:
                size = length[state] + 1
                state = following[state][symbol]
        if size >= least:
            out.append((len(symbols) - size, len(symbols), state))
        return out


class Scanner:
    """Templates and phrases, ready to scan texts."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> None:
        templates, phrases = templates or TEMPLATES, phrases or PHRASES
        cut = {name: words_of(text.encode()) for name, text in templates.items()}
        self.phrases = [(words_of(text.encode()), label) for text, label in phrases.items()]
        known = sorted({w for ws in [*cut.values(), *(p for p, _ in self.phrases)] for w in ws})
        self.ids = {w: i + 1 for i, w in enumerate(known)}
        self.names = list(cut)
        self.index = {name: t for t, name in enumerate(self.names)}
        self.sequences = [[self.ids[w] for w in ws] for ws in cut.values()]
        self.phrase_ids = [([self.ids[w] for w in ws], label) for ws, label in self.phrases]
        self.automaton = SuffixAutomaton()
        for t, symbols in enumerate(self.sequences):
            self.automaton.add(t, symbols)
        self.automaton.finish(self.sequences)

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase stands."""
        out = []
        for phrase, label in self.phrase_ids:
            last = len(phrase) - 1
            at = np.flatnonzero(ids[last:] == phrase[-1]) if len(ids) > last else np.zeros(0, np.int64)
            for k, word in enumerate(phrase[:-1]):
                at = at[ids[at + k] == word]
            out += [(int(a), label) for a in at]
        return out

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(template, first, stop, cover) of each covered template; words of the text from 0."""
        known = ids != 0
        edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - first < LEAST_MATCH:
                continue  # an unknown word ends every match, so none here is long
            for a, b, state in self.automaton.matches(ids[first:stop].tolist(), LEAST_MATCH):
                for t, ends in self.automaton.ends[state].items():
                    by_template[t] += [(first + a, first + b, end + 1 - (b - a)) for end in ends]
        out = []
        for t, found in by_template.items():
            out += self._chains(t, sorted(found))
        return self._settled(sorted(out, key=lambda x: (x[1], x[2], x[0])))

    def _settled(self, spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Without spans of which another, that covers more, takes half: kindred wordings differ in a word or two."""
        strength = [(round(cover * len(self.sequences[self.index[name]])), cover) for name, _, _, cover in spans]
        longest = max((stop - first for _, first, stop, _ in spans), default=0)
        out = []
        low = 0
        for i, (_, first, stop, _) in enumerate(spans):
            while spans[low][1] + longest <= first:
                low += 1
            beaten = False
            for j in range(low, len(spans)):
                _, a, b, _ = spans[j]
                if a >= stop:
                    break
                if strength[j] > strength[i] and 2 * (min(b, stop) - max(a, first)) >= stop - first:
                    beaten = True
                    break
            if not beaten:
                out.append(spans[i])
        return out

    def _chains(self, t: int, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches (text first, text stop, template first) rising in text and template."""
        size = len(self.sequences[t])
        best: list[tuple[int, int, int]] = []  # words covered, where the chain starts, template end
        out: dict[int, tuple[int, int]] = {}
        low = 0
        for i, (a, b, at) in enumerate(found):
            end = at + b - a
            while found[low][1] + LARGEST_GAP + size < a:
                low += 1
            top = (b - a, a, end)
            for j in range(low, i):
                _, stop, _ = found[j]
                covered, start, done = best[j]
                if stop <= a and a - stop <= LARGEST_GAP and done <= at and covered + b - a > top[0]:
                    top = (covered + b - a, start, end)
            best.append(top)
            covered, start, _ = top
            if covered > out.get(start, (0, 0))[0]:
                out[start] = (covered, b)
        return [(self.names[t], start, stop, min(1.0, covered / size)) for start, (covered, stop) in out.items() if covered >= LEAST_COVER * size]

    def scan(self, data: bytes) -> dict:
        words = words_of(data)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        places, spans = self.places(ids), self.spans(ids)
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(name for name, *_ in spans)})
        starts = [a for a, _ in places]
        cover = max([x[3] for x in spans], default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(labels),
            "score": 1 - (1 - cover) * (1 - MENTION * bool(places)),
            "spans": [{"template": n, "first": a, "stop": b, "cover": c} for n, a, b, c in spans],
        }


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "spans array<struct<template:string,first:long,stop:long,cover:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = scanner()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))]
    for batch in batches:
        rows = [one.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` in the columns of ``SCHEMA`` and spans, in words of the text."""
    return docs.select("doc_id", "text").mapInArrow(_scan, f"{SCHEMA}, {SPANS}")
