"""Licence texts in documents: Dice coefficient over word bigrams between units of a text and licence templates.

A unit is a line, a block of lines between lines without words (if it has more than one), or the whole text (if it has more
than one block). Words are runs of letters and digits, A-Z lower-cased. With A and B the bigrams of unit and template, counted
as often as they come, the score is 2 |A & B| / (|A| + |B|). For a score of t it takes |A| t / (2 - t) <= |B| <= |A| (2 - t) / t, which leaves few
templates a unit, and at least |A| t / (2 - t) bigrams of A must come from some template, which leaves few units; both are counted in numpy.

A passage is a run of words anywhere in a text, across lines and blocks: for each template, the run with the best score of all sizes, then the
next best that does not overlap it, and so on. The best run from one place begins and ends with bigrams of the template, and |B| t / (2 - t) of
them lie within |B| (2 - t) / t, which leaves few places. A passage is left out if a unit found, or a passage, that shares more bigrams with
its own template has half of its words, and that template half of the bigrams by which it was found.

Defined results: null text has no units. A unit matches its best template (whole texts, headers and notices); on equal scores the first name wins. Units with fewer
than two words match nothing. Rows that repeat are scanned each. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil, floor
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.text import LOWER, Chunk, RangeKeys, chunks, lines, mix, words

THRESHOLD = 0.7
_U = np.uint64
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False

# Wording of licences and of the notices by which texts name them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    "BSD notice": "Released under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Whole texts and standard headers, a file each in `licences/`.
FILES = """AGPL-3.0;AGPL-3.0 header;Apache-2.0;Artistic-1.0;BSD-2-Clause;BSD-3-Clause;BSD-3-Clause Regents;CC-BY-4.0;CC-BY-NC-4.0;CC-BY-NC-ND-4.0;CC-BY-NC-SA-4.0;CC-BY-ND-4.0;CC-BY-SA-4.0;CC0-1.0;GFDL-1.2;
GFDL-1.3;GFDL-1.3 header;GPL-1.0;GPL-2.0;GPL-2.0 header;GPL-3.0;GPL-3.0 header;ISC;LGPL-2.0;LGPL-2.1;LGPL-2.1 header;LGPL-3.0;LGPL-3.0 header;
MIT;MPL-1.1;MPL-1.1 header;MPL-2.0;NCSA;OFL-1.1;Unlicense;Zlib""".replace("\n", "").split(";")
TEMPLATES |= {n if n.endswith(" header") else f"{n} full text": " ".join(get_data(__package__, f"licences/{n}.txt").decode().split()) for n in FILES}


def _bigrams(chunk: Chunk):
    """Words of a chunk, and the key of each word with its next one (whatever line or row that is in)."""
    low = chunk._replace(data=LOWER[chunk.data])
    found = words(low, _OUTSIDE)
    keys = RangeKeys(low.data)(found.start, found.end)
    return found, mix(keys[:-1] * _U(0x9FB21C651E98DF25) + keys[1:])


class Templates:
    """Bigram counts of the templates, in order of size."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        known = []
        for name, text in texts.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            grams = Counter(_bigrams(Chunk(0, raw, np.array([0, len(raw)])))[1].tolist())
            if grams:
                known.append((sum(grams.values()), name, grams))
        known.sort(key=lambda k: k[:2])
        self.sizes, self.names, self.grams = [k[0] for k in known], [k[1] for k in known], [k[2] for k in known]
        self.all = np.array(sorted({g for c in self.grams for g in c}), _U)
        self.index = [np.searchsorted(self.all, np.array(sorted(c), _U)) for c in self.grams]
        self.counts = [np.array([c[g] for g in sorted(c)], np.int32) for c in self.grams]

    def best(self, grams: list[int]) -> tuple[str, float] | None:
        """The template most like a unit with these bigrams, if any reaches the threshold."""
        size, t = len(grams), self.threshold
        counted, top = Counter(grams), None
        for k in range(bisect_left(self.sizes, size * t / (2 - t) - 1e-9), bisect_right(self.sizes, size * (2 - t) / t + 1e-9)):
            other = self.grams[k]
            shared = sum(min(n, other[g]) for g, n in counted.items() if g in other)
            score = 2 * shared / (size + self.sizes[k])
            if score >= t and (top is None or (-score, self.names[k]) < (-top[1], top[0])):
                top = self.names[k], score
        return top


    def counted(self, k: int) -> np.ndarray:
        """How often template ``k`` has each bigram of ``all``."""
        out = np.zeros(len(self.all), np.int32)
        out[self.index[k]] = self.counts[k]
        return out

    def runs(self, k: int, place: np.ndarray, gram: np.ndarray, row: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(score, shared, first bigram, one past the last) of the best runs for template ``k`` that do not overlap.

        ``place``, ``gram`` and ``row`` are those of the bigrams of any template in a chunk: where, which of ``all``, in which row.
        """
        n, t, often = self.sizes[k], self.threshold, self.counted(k)
        need, longest = max(1, ceil(n * t / (2 - t) - 1e-9)), floor(n * (2 - t) / t + 1e-9)
        mine = often[gram] > 0
        place, gram, row = place[mine], gram[mine], row[mine]
        first = np.arange(len(place) - need + 1)
        last = first + need - 1
        first = first[(place[last] - place[first] < longest) & (row[last] == row[first])] if len(first) else first
        if not len(first):
            return []
        end = np.minimum(np.searchsorted(place, place[first] + longest), np.searchsorted(row, row[first], "right"))
        # A bigram counts in a run that begins with bigram i if fewer than its count in the template come between; when i leaves, a later one gets its turn.
        order = np.argsort(gram, kind="stable")
        group = gram[order]
        rank = np.arange(len(order)) - np.searchsorted(group, group)
        after = np.arange(len(order)) + often[group]
        same = after < len(order)
        same[same] = group[after[same]] == group[same]
        turn = np.full(len(order), len(order))
        turn[order[same]] = order[after[same]]
        counts = np.zeros(len(order) + 1, np.int32)
        counts[order] = rank < often[group]
        found, gone = [], 0
        for i, j in zip(first.tolist(), end.tolist(), strict=True):
            counts[turn[gone:i]] = 1
            gone = i
            shared = np.cumsum(counts[i:j])
            score = 2 * shared / (place[i:j] - place[i] + 1 + n)
            top = int(score.argmax())
            if score[top] >= t:
                found.append((float(score[top]), int(shared[top]), int(place[i]), int(place[i + top]) + 1))
        found.sort(key=lambda r: (-r[0], r[2]))
        taken, out = np.zeros(int(place[-1]) + 1, bool), []
        for r in found:
            if not taken[r[2]:r[3]].any():
                taken[r[2]:r[3]] = True
                out.append(r)
        return out

    def passages(self, place: np.ndarray, gram: np.ndarray, row: np.ndarray, known: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, float]]:
        """(first bigram, one past the last, licence, score) of passages, beside the units ``known``: (first, one past the last, shared, licence)."""
        ranked = [(-shared, 0, 0.0, licence, a, b) for a, b, shared, licence in known]
        for k, licence in enumerate(self.names):
            ranked += [(-shared, 1, -score, licence, a, b) for score, shared, a, b in self.runs(k, place, gram, row)]
        kept, out = [], []
        at = {licence: k for k, licence in enumerate(self.names)}
        has = {licence: self.counted(at[licence])[gram] > 0 for licence in {r[3] for r in ranked}}
        for _, passage, score, licence, a, b in sorted(ranked):
            if passage:
                inside = slice(*np.searchsorted(place, [a, b]))
                mine = has[licence][inside]
                if any(2 * (min(b, d) - max(a, c)) >= b - a and 2 * np.count_nonzero(mine & has[other][inside]) >= np.count_nonzero(mine) for c, d, other in kept):
                    continue
                out.append((a, b, licence, -score))
            kept.append((a, b, licence))
        return out


def units(chunk: Chunk, first_word: np.ndarray) -> list[tuple[str, np.ndarray, ...]]:
    """(kind, row, first line, last line, first word, one past the last word) of the units; lines count from 1 in each row."""
    start, end = lines(chunk)
    row = np.searchsorted(chunk.offsets, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, chunk.offsets[:-1])[row] + 1
    a, b = np.searchsorted(first_word, start), np.searchsorted(first_word, end)
    full = np.flatnonzero(b > a)
    row, number, a, b = row[full], number[full], a[full], b[full]
    new_row = np.append(True, row[1:] != row[:-1])[: len(row)]
    new = new_row | np.append(True, number[1:] != number[:-1] + 1)[: len(row)]
    out = [("line", row, number, number, a, b)]
    for kind, begins, several in (("block", new, np.ones(len(row), np.int64)), ("text", new_row, new.astype(np.int64))):
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        if len(first):
            keep = np.add.reduceat(several, first) > 1
            first, last = first[keep], last[keep]
        out.append((kind, row[first], number[first], number[last], a[first], b[last]))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
         passages: bool = False) -> DataFrame:
    """(id, unit, first_line, last_line, licence, score) of each unit that matches a template; with ``passages``, of passages beside them as well."""
    known = Templates(templates or TEMPLATES, threshold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found, grams = _bigrams(chunk)
                if not len(grams):
                    continue
                at = np.minimum(np.searchsorted(known.all, grams), len(known.all) - 1)
                hit = known.all[at] == grams
                hits = np.concatenate([[0], np.cumsum(hit)])
                out, matched = [], []
                for kind, row, first, last, a, b in units(chunk, found.start):
                    size = b - a - 1
                    likely = np.flatnonzero((size > 0) & (hits[np.maximum(b - 1, a)] - hits[a] >= size * threshold / (2 - threshold) - 1e-9))
                    for u in likely.tolist():
                        best = known.best(grams[a[u]:b[u] - 1].tolist())
                        if best:
                            out.append((int(row[u]) + chunk.first, kind, int(first[u]), int(last[u]), *best))
                            n = known.sizes[known.names.index(best[0])]
                            matched.append((int(a[u]), int(b[u]) - 1, round(best[1] * (int(size[u]) + n) / 2), best[0]))
                if passages:
                    place = np.flatnonzero(hit & (found.row[:-1] == found.row[1:]))
                    begins = lines(chunk)[0]
                    number = np.searchsorted(begins, found.start, "right") - np.searchsorted(begins, chunk.offsets[:-1])[found.row]
                    for a, b, name, score in known.passages(place, at[place], found.row[place], matched):
                        out.append((int(found.row[a]) + chunk.first, "passage", int(number[a]), int(number[b]), name, score))
                if out:
                    where, kind, first, last, name, score = zip(*out, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(where)), pa.array(kind), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                                           pa.array(name), pa.array(score, pa.float64())], ["id", "unit", "first_line", "last_line", "licence", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, unit string, first_line int, last_line int, licence string, score double")
