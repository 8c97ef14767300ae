"""Licence scans: a generalised suffix automaton of licence templates, run over every text.

The automaton holds all the templates' token sequences. Streaming a text's words through it gives,
at each word, the longest suffix of the text so far that occurs in any template (matching
statistics). Phrases and names are found where the state's suffixes include a whole one; maximal long
matches are chained, along each template that holds them, into covered spans. A span gives its
template's label if it covers enough of the template, and if no span of another label that lies over
it covers more of its own: so what licences have in common goes to the one that it fits best, and a
sentence of one gives nothing. A name gives its label where it stands whole, with its version.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; overlapping
places all count; words outside all templates end a match; a match in several templates counts in
each of them, at each of its places; repeated rows get equal results; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import id_text, map_rows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices that licences ask to be put into files, and their labels.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "mit": (
        "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"
    ),
    "gpl": (
        "licensed under the gnu general public license version 3 this program is free software you can redistribute it and "
        "or modify it under the terms of the gnu general public license as published by the free software foundation"
    ),
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be "
        "misrepresented you must not claim that you wrote the original software"
    ),
    "bsl-1.0": "boost software license version 1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by": "licensed under cc by 4.0 creative commons attribution 4.0 international",
    "cc-by-nc": "licensed under cc by nc 4.0 creative commons attribution noncommercial 4.0 international",
    "cc-by-sa": "licensed under cc by sa 4.0 creative commons attribution sharealike 4.0 international",
}
# What two whole licences go on with after their notices.
MIT_END = (
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
    "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
BSD_END = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright "
    "holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
)
#: Whole licences: a text counts for its label like the notice of the same label.
WHOLE = {"mit": TEMPLATES["mit"].removeprefix("released under the mit license ") + " " + MIT_END, "bsd": TEMPLATES["bsd"] + " " + BSD_END}
# Names that stand for a licence, with the version where it has one.
NAMES = {
    "apache license version 2.0": "apache-2.0", "apache license 2.0": "apache-2.0", "the mit license": "mit", "bsd 2 clause license": "bsd", "bsd 3 clause license": "bsd",
    "gnu general public license version 2": "gpl", "gnu general public license version 3": "gpl", "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl", "mozilla public license version 2.0": "mpl-2.0", "mozilla public license v 2.0": "mpl-2.0", "the isc license": "isc",
    "the zlib license": "zlib", "boost software license version 1.0": "bsl-1.0", "eclipse public license version 2.0": "epl-2.0", "eclipse public license 2.0": "epl-2.0",
    "cc0 1.0 universal": "cc0", "cc by 4.0": "cc-by", "cc by nc 4.0": "cc-by-nc", "cc by sa 4.0": "cc-by-sa",
}
#: Words of a match that counts towards a template, and words of a chain that is a span.
LEAST_MATCH, LEAST_CHAIN = 4, 5
#: The part of a template that a span covers if it gives a label.
ENOUGH = 0.5
#: Words that a chain may skip in the text between two matches.
GAP = 6


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """A suffix automaton of several sequences. Each state keeps the templates and positions at which its
    strings end, and the whole phrases and names among its suffixes. templates: (label, text)."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], names: dict[str, str] | None = None):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.names = [label for label, _ in templates]
        self.lengths = []
        for _, text in templates:
            seq = words_of(text)
            self.lengths.append(len(seq))
            last = 0
            for w in seq:
                last = self._add(last, w)
        own: dict[int, list[tuple[int, str, bool]]] = {}
        for phrase, label, base in [(p, x, True) for p, x in phrases.items()] + [(p, x, False) for p, x in (names or {}).items()]:
            last, seq = 0, words_of(phrase)
            for w in seq:
                last = self._add(last, w)
            own.setdefault(self.walk(seq), []).append((len(seq), label, base))
        self.ends: list[tuple] = [()] * len(self.size)
        for v in sorted(range(len(self.size)), key=self.size.__getitem__):
            up = self.ends[self.link[v]] if self.link[v] >= 0 else ()
            self.ends[v] = up + tuple(own.get(v, ()))
        places: list[set] = [set() for _ in self.size]
        for k, (_, text) in enumerate(templates):
            v = 0
            for i, w in enumerate(words_of(text)):
                v = self.next[v][w]
                places[v].add((k, i))
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[v] > 0:
                places[self.link[v]] |= places[v]
        #: (template, position) of each end of a state's strings, and what part of a template a word of them is at most.
        self.at = [tuple(sorted(x)) for x in places]
        self.part = [1 / min((self.lengths[k] for k, _ in x), default=float("inf")) for x in places]

    def walk(self, seq: list[bytes]) -> int:
        v = 0
        for w in seq:
            v = self.next[v][w]
        return v

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.size.append(size)
        return len(self.size) - 1

    def _add(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.size[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.size[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def statistics(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(place, state, length) at each word where some match ends; others match nothing."""
        out, v, n = [], 0, 0
        follow, link, size = self.next, self.link, self.size
        root = follow[0]
        for i, w in enumerate(words):
            if w not in root:  # in no template at all
                v = n = 0
                continue
            while w not in follow[v]:
                v = link[v]
                n = size[v]
            v, n = follow[v][w], n + 1
            out.append((i, v, n))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, int, bool]], float]:
        """(phrase places, spans, score). A place: (first word, label). A span: (label, first word, end, words of the template that
        its chain covers, whether it gives the label). Score: the greatest part of a template that a span or a match covers, a name being one."""
        found, places, named, matches, score = self.statistics(words), [], [], [], 0.0
        for k, (i, v, n) in enumerate(found):
            for m, label, base in self.ends[v]:
                if m <= n:
                    (places if base else named).append((i - m + 1, label) if base else (label, i - m + 1, i + 1, m, 1.0))
            if n < 2 or k + 1 < len(found) and found[k + 1][0] == i + 1 and found[k + 1][2] > n:
                continue
            score = max(score, n * self.part[v])
            if n >= LEAST_MATCH:
                matches += [(i - n + 1, i + 1, t, at, n) for t, at in self.at[v]]
        spans, open_ = [], {}
        for start, end, t, at, n in matches:
            if (s := open_.get(t)) and start - s[2] <= GAP and at > s[3]:
                if end > s[2]:
                    s[4] += min(n, at - s[3], end - s[2])
                    s[2], s[3] = end, at
            elif not s or end > s[2]:  # a match's second place in a template begins no span where its first goes on with one
                open_[t] = [t, start, end, at, n]
                spans.append(open_[t])
        chains = [(self.names[t], start, end, got, min(1.0, got / self.lengths[t])) for t, start, end, _, got in spans if got >= LEAST_CHAIN]
        return places, contrasted(chains + named), max([min(1.0, score), *(s[4] for s in chains + named)])


def contrasted(spans: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, bool]]:
    """Spans (label, first word, end, words covered, part covered), by place, with whether they give their label: they cover ENOUGH, and no span of
    another label that overlaps them covers as great a part with as many words, or a greater one; what fits two licences alike is neither's."""
    spans, out = sorted(spans, key=lambda s: (s[1], s[2], s[0], -s[3])), []
    longest = max((s[2] - s[1] for s in spans), default=0)
    for k, (label, first, end, got, part) in enumerate(spans):
        better = False
        for step in (-1, 1):
            j = k + step
            while part >= ENOUGH and not better and 0 <= j < len(spans) and (spans[j][1] < end if step > 0 else spans[j][1] > first - longest):
                other = spans[j]
                better = other[0] != label and other[1] < end and other[2] > first and (other[4], other[3]) >= (part, got)
                j += step
        out.append((label, first, end, got, part >= ENOUGH and not better))
    return out


def known() -> list[tuple[str, str]]:
    return [*TEMPLATES.items(), *WHOLE.items()]


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """For each row: n_words, n_base (phrase places), first_word, last_word (their least and greatest start), base_labels, labels,
    score (the greatest covered part of a template), spans (label:first:end of those that give labels, comma-joined)."""
    templates, phrases, names = templates or known(), phrases or PHRASES, NAMES if names is None else names

    def make():
        automaton = Automaton(templates, phrases, names)

        def each(batch):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                places, spans, score = automaton.scan(words)
                base, spans = {x for _, x in places}, [s for s in spans if s[4]]
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min((p for p, _ in places), default=None))
                out["last_word"].append(max((p for p, _ in places), default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {s[0] for s in spans})))
                out["score"].append(score)
                out["spans"].append(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans))
            return {"doc_id": batch.column(0), **out}

        return each

    return map_rows(id_text(df), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string", by=1)
