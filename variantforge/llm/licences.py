"""Licence scans: windows of a text against templates by the Dice coefficient over word bigrams.

Words are the runs of letters and digits of the lower-cased text.  Windows of all widths that can reach the
threshold t, from t / (2 - t) of the template's to its inverse, are scored where they begin and end at bigrams
of the template; others only lose by what sticks out.  A text whose size or whose bigrams in common fall short
of t / (2 - t) of the template's is never compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import normal
from .words import U64, mix, word_hashes

THRESHOLD = 0.8
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL_TAIL = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

#: The public notices that name a licence, and the first paragraphs of licence texts.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _tail(name: str) -> str:
    """What follows a licence's first paragraph in its whole text; empty if nothing does, or nothing that is listed here."""
    ends = {"MIT": " " + _AS_IS, "BSD-2-Clause": " " + _DISCLAIMER, "BSD-3-Clause": " " + _DISCLAIMER, "ISC": " " + _ISC_DISCLAIMER, "GPL-3.0-or-later": _GPL_TAIL, "GPL-2.0-or-later": _GPL_TAIL}
    return ends.get(name, "")


#: Notices and first paragraphs, and the whole texts of those licences whose first paragraph has over thirty words and a tail.
TEMPLATES = NOTICES + tuple((name, text + _tail(name)) for name, text in NOTICES if _tail(name) and len(text.split()) > 30)


def bigrams(words: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbours; of a single word, that word's."""
    if len(words) < 2:
        return words
    return mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])


def _words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    return word_hashes(pa.array([normal(t).decode("utf-8", "replace") for t in texts], pa.string()))


@dataclass(frozen=True)
class Template:
    name: str
    grams: np.ndarray
    kinds: np.ndarray
    counts: np.ndarray


class Templates:
    """Templates with an index of their bigrams."""

    def __init__(self, rows):
        grams = [bigrams(w) for _, w in _words([t for _, t in rows])]
        self.all = [Template(name, g, *np.unique(g, return_counts=True)) for (name, _), g in zip(rows, grams, strict=True) if len(g)]
        self.known = np.unique(np.concatenate([t.kinds for t in self.all])) if self.all else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.known >> U64(48)).astype(np.int64)] = True


def scan(templates: Templates, words: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(licence, dice, first word, words) of windows at or over the threshold; of overlapping ones the best, then the longest, then the first stays."""
    if not len(words) or not templates.all:
        return []
    grams = bigrams(words)
    near = np.flatnonzero(templates.table[(grams >> U64(48)).astype(np.int64)])
    near = near[np.isin(grams[near], templates.known)] if len(near) else near
    least = threshold / (2 - threshold)
    if len(near) < least * min(len(t.grams) for t in templates.all):
        return []
    found = []
    for t in templates.all:
        b = len(t.grams)
        if len(grams) < least * b:
            continue
        own = near[np.isin(grams[near], t.kinds)]
        if len(own) < least * b:
            continue
        # The best windows begin and end at one of the template's bigrams: those at own[i] and own[i + k].
        some = np.zeros(len(own), bool)
        for k in range(max(0, math.ceil(least * b - 1e-9) - 1), min(len(own), int(b / least + 1e-9))):
            width = own[k:] - own[: len(own) - k] + 1
            some[: len(own) - k] |= 2 * min(k + 1, b) >= threshold * (width + b) - 1e-9
        kind = np.searchsorted(t.kinds, grams[own]) if some.any() else own
        for i in np.flatnonzero(some):
            stop = int(np.searchsorted(own, own[i] + int(b / least + 1e-9)))
            part, width = kind[i:stop], own[i:stop] - own[i] + 1
            order = np.argsort(part, kind="stable")
            first = np.ones(len(part), bool)
            first[1:] = part[order[1:]] != part[order[:-1]]
            times = np.empty(len(part), np.int64)  # how often the bigram came before
            times[order] = np.arange(len(part)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            d = 2 * np.cumsum(times < t.counts[part]) / (width + b)
            found += [(-float(d[j]), -int(width[j]), int(own[i]), t.name) for j in np.flatnonzero(d >= threshold)]
    taken: list[tuple[int, int]] = []
    out = []
    for d, w, s, name in sorted(found):
        if all(s - w <= a or b <= s for a, b in taken):
            taken.append((s, s - w))
            out.append((name, -d, s, -w + (1 if len(words) > 1 else 0)))
    return sorted(out, key=lambda x: x[2])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per window of a row's text that is a licence: doc_id, licence, dice, first_word, n_words.

    Rows without one, null and empty texts among them, give none; rows repeated give rows repeated. Of
    overlapping windows only the best stays. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = part.column(0).to_pylist()
                rows += [(ids[k], *x) for k, words in _words(part.column(1).to_pylist()) for x in scan(known, words, threshold)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "licence", "dice", "first_word", "n_words"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, licence string, dice double, first_word bigint, n_words bigint")
