"""Operator 2: license scans by patience alignment.

A template's words are aligned with the words of a window of the text: words that occur once in both are
anchors, the longest increasing run of them is kept, and the gaps between are aligned the same way; a gap
without anchors takes a longest common subsequence. The aligned share of the template is its coverage.
A window starts at each word of the template in the text and is as long as the longest passage the density
allows, so any passage starts one; aligned words that stray from the passage are trimmed at both ends.
A window is aligned only if it holds enough of the template's different words to reach the coverage,
which leaves nothing out. Each document is read once, where it is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltlog.llm import kernels

COVERAGE = 0.8
#: The aligned words' share of the passage they span.
DENSITY = 0.75

#: Notices of well-known public licenses, and whole texts of short ones.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution."
    ),
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) whose second numbers increase."""
    ends: list[int] = []
    tails: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back.append(tails[at - 1] if at else -1)
        if at == len(ends):
            ends.append(j)
            tails.append(k)
        else:
            ends[at] = j
            tails[at] = k
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, by dynamic programming."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _once(words: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for k, w in enumerate(words):
        places[w] = -1 if w in places else k
    return {w: k for w, k in places.items() if k >= 0}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places of equal words, increasing on both sides."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = _once(a[a0:a1]), _once(b[b0:b1])
        anchors = _increasing([(i, right[w]) for w, i in left.items() if w in right])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            out.append((a0 + i, b0 + j))
            work.append((i0, a0 + i, j0, b0 + j))
            i0, j0 = a0 + i + 1, b0 + j + 1
        work.append((i0, a1, j0, b1))
    return sorted(out)


def _hashes(text: str) -> np.ndarray:
    for _, _, data, offsets in kernels.text_slices(pa.array([text], pa.string())):
        return kernels.words(kernels.ascii_lower(data), offsets, kernels.NOT_ALNUM)[0]
    return np.zeros(0, dtype=np.uint64)


class _Templates:
    def __init__(self, templates: Mapping[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.names = sorted(t for t in templates if len(_hashes(templates[t])))
        self.words = [_hashes(templates[n]).tolist() for n in self.names]
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], dtype=np.uint64))
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.sets = [set(t) for t in self.words]
        self.least = [_least(t, coverage) for t in self.words]
        self.grid = np.zeros((len(self.vocabulary), len(self.names)), dtype=np.float32)
        for k, s in enumerate(self.sets):
            self.grid[np.searchsorted(self.vocabulary, np.array(sorted(s), dtype=np.uint64)), k] = 1

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, vocabulary number) of each template word."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        return maybe[same], at[same]


def _least(template: list[int], coverage: float) -> int:
    """So many different words of a template are in any window that can reach the coverage."""
    return max(1, len(set(template)) - int((1 - coverage) * len(template) + 1e-9))


def _reach(n: int, density: float) -> int:
    """The words of the longest passage of a template of n words."""
    return max(n, int(n / density + 1e-9))


def _trim(places: list[int], least: float, density: float) -> tuple[int, int, int] | None:
    """(aligned words, first place, place after the last) of the run with most places, and of those the shortest, that is dense."""
    for size in range(len(places), 0, -1):
        if size < least - 1e-9:
            return None
        span, x = min((places[x + size - 1] - places[x] + 1, x) for x in range(len(places) - size + 1))
        if size >= density * span - 1e-9:
            return size, places[x], places[x + size - 1] + 1
    return None


def matches(words: list[int], template: list[int], coverage: float, density: float, windows: Iterator[int] | range) -> list[tuple[float, int, int, int]]:
    """(coverage, first word, word after the last, aligned words) of the template's passages, without overlaps.

    Starts are numbered by template lengths: number k has the windows that start in words k * n to (k + 1) * n
    for a template of n words. Of passages that overlap, the one with most aligned words stays, then the shortest.
    No window starts inside an exact copy: what overlaps one does not stay.
    """
    n, found, passed = len(template), [], 0
    held, least, reach = set(template), _least(template, coverage), _reach(len(template), density)
    for k in windows:
        for lo in range(k * n, min((k + 1) * n, len(words))):
            if lo < passed or words[lo] not in held:
                continue
            window = words[lo : lo + reach]
            if len(held.intersection(window)) < least:
                continue
            run = _trim([j for _, j in align(template, window)], coverage * n, density)
            if run:
                found.append((run[0] / n, lo + run[1], lo + run[2], run[0]))
                if run == (n, 0, n):
                    passed = lo + n
    out: list[tuple[float, int, int, int]] = []
    for m in sorted(set(found), key=lambda m: (-m[3], m[2] - m[1], m[1])):
        if all(m[2] <= x[1] or m[1] >= x[2] for x in out):
            out.append(m)
    return sorted(out, key=lambda m: m[1])


_SCHEMA = "doc_id long, license string, n_matches long, coverage double, start_word long, end_word long, aligned_words long"


def _scanner(templates: Mapping[str, str], coverage: float, density: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates(templates, coverage)
        for batch in batches:
            rows: list[tuple] = []
            for lo, hi, data, offsets in kernels.text_slices(batch.column(1)):
                hashes, _, _, first = kernels.words(kernels.ascii_lower(data), offsets, kernels.NOT_ALNUM)
                places, numbers = known.hits(hashes)
                owner = np.searchsorted(first, places, side="right") - 1
                present = np.zeros((hi - lo, len(known.vocabulary)), dtype=np.float32)
                present[owner, numbers] = 1
                counts = present @ known.grid
                for doc, t in zip(*np.nonzero(counts >= np.array(known.least))):
                    a, b = np.searchsorted(owner, doc), np.searchsorted(owner, doc, side="right")
                    n = len(known.words[t])
                    reach = _reach(n, density)
                    held: dict[int, set[int]] = {}
                    for p, w in zip((places[a:b] - first[doc]).tolist(), numbers[a:b].tolist()):
                        if known.grid[w, t]:
                            for k in range(max(0, (p - reach + 1) // n), p // n + 1):
                                held.setdefault(k, set()).add(w)
                    windows = sorted(k for k, s in held.items() if len(s) >= known.least[t])
                    found = matches(hashes[first[doc] : first[doc + 1]].tolist(), known.words[t], coverage, density, windows) if windows else []
                    if found:
                        best = max(found, key=lambda m: (m[0], -m[1]))
                        rows.append((batch.column(0)[lo + int(doc)].as_py(), known.names[t], len(found), round(best[0], 6), best[1], best[2], best[3]))
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(7)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "n_matches", "coverage", "start_word", "end_word", "aligned_words"])

    return run


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row per document and license found: doc_id, license, n_matches, and of the best match coverage,
    start_word, end_word (exclusive) and aligned_words.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts
    match nothing; a template without words is left out; repeated rows are reported each; an empty table
    gives no rows; extra columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_scanner(dict(templates), coverage, density), _SCHEMA)
