"""License scans with a positional index of rare words.

The index holds, for every word of the licence templates, its postings (template, position). A
word's weight is its inverse document frequency over all documents. A file's licence words are
looked up from the rarest on, each in the postings of the templates it stands in: an occurrence at
word ``p`` of a word that stands at ``q`` in a template is a hit at the relative position ``p - q``.
A template needs no further look-up once its words that are left in the file weigh too little to
reach ``threshold`` by themselves, so whatever is accepted holds a word that was looked up: nothing
is capped and nothing missed.

Hits are summed over neighbouring relative positions: the score of a start ``s`` is the greatest
weight, as a share of the template's, of hits in rising order whose relative positions lie in
``s .. s + GAP``. Up to ``GAP`` words may thus be inserted into a notice or be missing from it. A
start counts if its score reaches the threshold and every mandatory phrase stands inside the
stretch; of the counting starts of a template within ``GAP`` words the best is kept (ties: the last,
where an unchanged notice really starts). Besides, each place of a base phrase counts by itself.

A document is lower-cased in A-Z only; words are runs of letters a-z, digits and bytes outside ASCII.

Defined results: NULL and empty texts have no words, no labels and a score of 0. ``score`` is the best
of the starts that were looked at; without any it is 0. Each row is judged by itself, so repeated rows get equal
results and a NULL ``doc_id`` stays NULL. A start may lie before the first word of a document (a cut
notice); what is outside does not match. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablescout.llm.common import as_identifier, identifier
from tablescout.llm.words import buffers

THRESHOLD = 0.8
#: Words that may be inserted into a notice or be missing from it.
GAP = 4
_EPSILON = 1e-9

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A notice, its label and the phrases without which it is not that notice."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# Openings, conditions, disclaimers and identifier lines of well-known public notices.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
             " associated documentation files", ("free of charge", "obtaining a copy")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the"
             " GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
             " that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
             " of the Software", ("this permission notice", "substantial portions")),
    Template("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to"
             " the warranties of merchantability, fitness for a particular purpose and noninfringement",
             ("without warranty of any kind", "noninfringement")),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
             " on an as is basis, without warranties or conditions of any kind, either express or implied",
             ("warranties or conditions of any kind",)),
    Template("gpl", "redistribute it and/or modify it under the terms of version 2 of the GNU General Public License",
             ("gnu general public license",)),
    Template("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied"
             " warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details",
             ("gnu general public license",)),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
             " disclaimer", ("redistributions of source code", "following disclaimer")),
    Template("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties,"
             " including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
             ("copyright holders and contributors", "are disclaimed")),
    Template("mit", "SPDX-License-Identifier: MIT", ("identifier mit",)),
    Template("apache", "SPDX-License-Identifier: Apache-2.0", ("identifier apache",)),
    Template("gpl", "SPDX-License-Identifier: GPL-2.0", ("identifier gpl",)),
    Template("gpl", "SPDX-License-Identifier: GPL-3.0", ("identifier gpl",)),
    Template("lgpl", "SPDX-License-Identifier: LGPL-2.1", ("identifier lgpl",)),
    Template("lgpl", "SPDX-License-Identifier: LGPL-3.0", ("identifier lgpl",)),
    Template("bsd", "SPDX-License-Identifier: BSD-2-Clause", ("identifier bsd",)),
    Template("bsd", "SPDX-License-Identifier: BSD-3-Clause", ("identifier bsd",)),
    Template("mpl", "SPDX-License-Identifier: MPL-2.0", ("identifier mpl",)),
    Template("unlicense", "SPDX-License-Identifier: Unlicense", ("identifier unlicense",)),
)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _words(text: str) -> list[bytes]:
    return words_of(text.encode())


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases:
        at = -1
        last = phrase[-1]
        try:
            while True:
                at = words.index(last, at + 1)
                start = at - len(phrase) + 1
                if start >= 0 and words[start : at + 1] == phrase:
                    found.append((start, label))
        except ValueError:
            pass
    return found


class Index:
    """Positional postings of the templates' words, weighted by their rarity."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], threshold: float, gap: int):
        self.threshold, self.gap = threshold, gap
        self.templates = [(t.label, _words(t.text), [_words(p) for p in t.mandatory]) for t in templates]
        self.weights = [[idf[w] for w in words] for _, words, _ in self.templates]
        self.totals = [sum(weights) for weights in self.weights]
        self.idf = idf
        self.order = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for i, (_, words, _) in enumerate(self.templates):
            for q, word in enumerate(words):
                self.postings.setdefault(word, {}).setdefault(i, []).append(q)
        self.phrases = [(_words(p), label) for p, label in PHRASES]

    def lookups(self, present: list[bytes]) -> dict[bytes, list[int]]:
        """The templates in which each of a file's licence words, rarest first, is looked up."""
        left: dict[int, float] = {}
        for word in present:
            for i, at in self.postings[word].items():
                left[i] = left.get(i, 0.0) + self.idf[word] * len(at)
        chosen: dict[bytes, list[int]] = {}
        for word in present:
            for i, at in self.postings[word].items():
                if left[i] >= self.threshold * self.totals[i] - _EPSILON:
                    chosen.setdefault(word, []).append(i)
                    left[i] -= self.idf[word] * len(at)
        return chosen

    def score(self, i: int, start: int, words: list[bytes]) -> float:
        """Share of template ``i`` in the heaviest rising chain of hits at ``start`` to ``start + gap``."""
        size, n = self.gap + 1, len(words)
        row = [0.0] * size  # heaviest chain up to the last template word and the file's word at each shift
        for q, (word, weight) in enumerate(zip(self.templates[i][1], self.weights[i])):
            following, best = [], row[0]
            for d in range(size):
                best = max(best, row[min(d + 1, self.gap)])
                p = start + q + d
                if 0 <= p < n and words[p] == word:
                    best = max(best, row[d] + weight)
                following.append(best)
            row = following
        return min(1.0, max(row) / self.totals[i])

    def matches(self, words: list[bytes]) -> tuple[float, list[tuple[str, int, float]]]:
        """Best score of all starts, and the accepted ones as (label, start, score)."""
        chosen = self.lookups(sorted(self.postings.keys() & set(words), key=self.order.__getitem__))
        if not chosen:
            return 0.0, []
        starts: dict[int, set[int]] = {}
        for p, word in enumerate(words):
            for i in chosen.get(word, ()):
                for q in self.postings[word][i]:
                    starts.setdefault(i, set()).update(range(p - q - self.gap, p - q + 1))
        best, found = 0.0, []
        for i in sorted(starts):
            label, notice, mandatory = self.templates[i]
            accepted = []
            for start in starts[i]:
                score = self.score(i, start, words)
                best = max(best, score)
                if score >= self.threshold - _EPSILON:
                    stretch = words[max(start, 0) : max(start + len(notice) + self.gap, 0)]
                    if all(phrase_places(stretch, [(p, "")]) for p in mandatory):
                        accepted.append((-score, -start))
            kept: dict[int, float] = {}
            for score, start in sorted(accepted):
                if not any(s in kept for s in range(-start - self.gap, -start + self.gap + 1)):
                    kept[-start] = -score
            found += [(label, start, kept[start]) for start in sorted(kept)]
        return best, found


def _frequencies(vocabulary: frozenset[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        total = 0
        for batch in batches:
            offsets, data = buffers(batch["text"])
            view = memoryview(data)
            total += len(offsets) - 1
            for i in range(len(offsets) - 1):
                for word in vocabulary.intersection(words_of(bytes(view[offsets[i] : offsets[i + 1]]))):
                    counts[word] += 1
        hit = [(w, n) for w, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in hit)], pa.binary()), pa.array([total, *(n for _, n in hit)], pa.int64())],
                                         names=["word", "n"])

    return run


_RESULT = ("did long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, matches array<struct<label:string,start:int,score:double>>")


def _scanned(templates: tuple[Template, ...], idf: dict[bytes, float], threshold: float, gap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(templates, idf, threshold, gap)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
            [("label", pa.string()), ("start", pa.int32()), ("score", pa.float64())]))]
        names = ["did", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for batch in batches:
            offsets, data = buffers(batch["text"])
            view = memoryview(data)
            rows = []
            for i, did in enumerate(batch["did"].to_pylist()):
                words = words_of(bytes(view[offsets[i] : offsets[i + 1]]))
                base = phrase_places(words, own.phrases)
                score, found = own.matches(words)
                starts = [p for p, _ in base]
                labels = {label for _, label in base}
                rows.append((did, len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(labels)), ",".join(sorted(labels | {m[0] for m in found})), score,
                             [dict(zip(("label", "start", "score"), m)) for m in found]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=names)

    return run


def scan_licenses(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD,
                  gap: int = GAP) -> DataFrame:
    """Words, base places, labels, best score and accepted notices per row of ``documents(doc_id, text)``."""
    texts = documents.select(identifier().alias("did"), "text")
    vocabulary = frozenset(w for t in templates for w in _words(t.text))
    counted = texts.mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in counted.collect()}  # a row per template word at most
    total = counts.get(None, 0)
    idf = {w: math.log1p((total - counts.get(w, 0) + 0.5) / (counts.get(w, 0) + 0.5)) for w in vocabulary}
    found = texts.mapInArrow(_scanned(templates, idf, threshold, gap), _RESULT)
    return found.select(as_identifier("did").alias("doc_id"), *(c for c in found.columns if c != "did"))
