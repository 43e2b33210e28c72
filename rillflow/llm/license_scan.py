"""License scans by patience alignment.

Templates are whole licences and headers, and one-line notices. The words that name a licence and its version are fixed
anchors: a text must have them word for word, so one word's difference there is another licence. Around each of their places
(of each distinctive word, if a long template has none) the words are aligned with the template: words unique to both sides are anchors, their longest increasing subsequence is kept, and the gaps between anchors are aligned the same way.
Coverage is the share of the template's words that are aligned. A match that spans a clause of another licence's is none. Every place of every text is tried; overlapping matches of
one template count once, the best first.

Defined cases: a null or empty text has no licence; ties in coverage go to the longer template, then to the smaller name,
then to the earlier place; repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. {Redistributions of source code} must retain the above copyright notice, this list of conditions and the following disclaimer. 2. {Redistributions in binary form} must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors {may be used to endorse or promote products derived from this software} without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(what: str, name: str, version: str) -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {{{name}}} as published by the Free Software Foundation, either {{version {version} of the License}}, or (at your option) any later version."


# Public licences and notices, by SPDX identifier. What is in braces names the licence: it must be in a text
# word for word.
NOTICES = {
    "AGPL-3.0-header": _gnu("program", "GNU Affero General Public License", "3"),
    "Apache-2.0": "Licensed under the {Apache License, Version 2.0}.",
    "Apache-2.0-header": 'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} 3. {_BSD_NAME} {_BSD_TAIL}",
    "BSD-4-Clause": f"{_BSD_HEAD} 3. {{All advertising materials mentioning features or use of this software}} must display the following acknowledgement: This product includes software developed by the organization. 4. {_BSD_NAME} {_BSD_TAIL}",
    "CC-BY-4.0": "This work is licensed under a {Creative Commons Attribution 4.0 International} License.",
    "CC-BY-4.0-short": "Licensed under {CC BY 4.0}.",
    "CC-BY-NC-4.0": "Licensed under {CC BY-NC 4.0}.",
    "CC-BY-NC-4.0-work": "This work is licensed under a {Creative Commons Attribution-NonCommercial 4.0 International} License.",
    "CC-BY-NC-ND-4.0": "Licensed under {CC BY-NC-ND 4.0}.",
    "CC-BY-NC-SA-4.0": "Licensed under {CC BY-NC-SA 4.0}.",
    "CC-BY-ND-4.0": "Licensed under {CC BY-ND 4.0}.",
    "CC-BY-SA-4.0": "Licensed under {CC BY-SA 4.0}.",
    "CC-BY-SA-4.0-work": "This work is licensed under a {Creative Commons Attribution-ShareAlike 4.0 International} License.",
    "GPL-2.0": "This work is licensed under the {GNU General Public License, version 2}.",
    "GPL-2.0-header": _gnu("program", "GNU General Public License", "2"),
    "GPL-3.0": "This work is licensed under the {GNU General Public License, version 3}.",
    "GPL-3.0-header": _gnu("program", "GNU General Public License", "3"),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice {appear in all copies}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": _gnu("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _gnu("library", "GNU Lesser General Public License", "3"),
    "MIT": "Released under the {MIT License}.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and {associated documentation files} (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in {all copies or substantial portions of the Software}. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: Words of clauses that make another licence of one whose template lacks them (fixed values).
FOREIGN = ("all advertising materials", "used to endorse or promote", "good not evil", "except as contained in this notice")
#: Templates without braces of up to so many words need all their distinctive words.
SHORT = 16
#: Words too common to start a match (a fixed list).
COMMON = frozenset("a an and any are as at be by can either following for free from in is it may not of on or option provided that the this to under use version with without work you your".split())
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = ends[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[p], ends[p] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(a[i:j], i) if ca[w] == 1 and cb.get(w) == 1}
        pairs = [(place[w], q) for q, w in enumerate(b[k:m], k) if w in place]
        anchors = [pairs[x] for x in increasing([p for p, _ in pairs])]
        if not anchors:
            continue
        out += anchors
        i0, k0 = i, k
        for p, q in [*anchors, (j, m)]:
            if p > i0 and q > k0:
                todo.append((i0, p, k0, q))
            i0, k0 = p + 1, q + 1
    return sorted((p + a0, q + b0) for p, q in out)


def named(template: str) -> list[tuple[int, int]]:
    """(first, end) of the words that a text must have word for word: those in braces, or a short notice's distinctive ones."""
    out, n = [], 0
    for i, part in enumerate(re.split(r"[{}]", template)):
        m = n + len(words(part))
        if i % 2 and m > n:
            out.append((n, m))
        n = m
    if not out and n <= SHORT:
        out = [(i, i + 1) for i, w in enumerate(words(template)) if w not in COMMON]
    return out


def place_of(run: list[str], text: list[str], lo: int, hi: int) -> int:
    """First place in text[lo:hi] of a run of words, or -1."""
    return next((i for i in range(lo, min(hi, len(text)) - len(run) + 1) if text[i] == run[0] and text[i : i + len(run)] == run), -1)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.templates = {k: words(v) for k, v in sorted(templates.items())}
        self.named = {k: named(v) for k, v in templates.items()}
        self.foreign = {k: [f for f in map(words, FOREIGN) if place_of(f, t, 0, len(t)) < 0] for k, t in self.templates.items()}
        self.coverage = coverage
        self.seeds: dict[str, list[str]] = {}
        for name, t in self.templates.items():
            # A match has the first named words, so their places are all that need a look.
            for w in {t[self.named[name][0][0]]} if self.named[name] else sorted({w for w in t if w not in COMMON} or set(t)):
                self.seeds.setdefault(w, []).append(name)
        self.any = frozenset(self.seeds)

    def around(self, text: list[str], name: str, place: int) -> tuple[float, int, int, int]:
        """As at(), with the named words as fixed anchors, the first of them at a place; no coverage without all of them."""
        t, pairs = self.templates[name], []
        slack = 2 + len(t) // 2
        i, lo, at = 0, max(0, place - self.named[name][0][0] - slack), place
        for n, (first, end) in enumerate(self.named[name]):
            at = place_of(t[first:end], text, at, at + (end - first if n == 0 else first - i + slack + end - first))
            if at < 0:
                return 0.0, 0, place, place
            pairs += align(text[lo:at], t[i:first], lo, i) + [(at + x, first + x) for x in range(end - first)]
            i, at = end, at + end - first
            lo = at
        pairs += align(text[lo : lo + len(t) - i + slack], t[i:], lo, i)
        if any(place_of(f, text, pairs[0][0], pairs[-1][0] + 1) >= 0 for f in self.foreign[name]):
            return 0.0, 0, place, place
        return len(pairs) / len(t), len(pairs), pairs[0][0], pairs[-1][0]

    def at(self, text: list[str], name: str, place: int) -> tuple[float, int, int, int]:
        """Coverage, aligned words, first and last aligned place of a template around a place."""
        t = self.templates[name]
        lo = max(0, place - len(t) - 2)
        pairs = align(text[lo : place + len(t) + 3], t, lo)
        return (len(pairs) / len(t), len(pairs), pairs[0][0], pairs[-1][0]) if pairs else (0.0, 0, place, place)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, aligned words, first place, last place) of every match, best first for each template."""
        found = words(text)
        if self.any.isdisjoint(found):
            return []
        places: dict[str, list[int]] = {}
        for i, w in enumerate(found):
            for name in self.seeds.get(w, ()):
                places.setdefault(name, []).append(i)
        out = []
        for name, at in places.items():
            need = self.coverage * len(self.templates[name])
            hits = []
            if self.named[name]:
                for i in at:
                    c, n, a, b = self.around(found, name, i)
                    if c >= self.coverage:
                        hits.append((-c, b - a, a, b, n))
                at = []
            vocabulary = frozenset(self.templates[name])
            for i in at:
                lo = max(0, i - len(self.templates[name]) - 2)
                if len(vocabulary.intersection(found[lo : i + len(self.templates[name]) + 3])) >= need - (len(self.templates[name]) - len(vocabulary)):
                    c, n, a, b = self.at(found, name, i)
                    if c >= self.coverage:
                        hits.append((-c, b - a, a, b, n))
            taken: list[tuple[int, int]] = []
            for c, _, a, b, n in sorted(set(hits)):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    out.append((name, -c, n, a, b))
        return out

    def best(self, matches: list[tuple[str, float, int, int, int]]) -> tuple | None:
        return min(matches, key=lambda x: (-x[1], -len(self.templates[x[0]]), x[0], x[3]), default=None)


_ROW = "doc_id long, license string, coverage double, matched_words long, first_word long, last_word long, n_notices long, licenses string"
_ROW_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in _ROW.split(", ")])


def _scan(templates: dict[str, str], coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            cols: list[list] = [[] for _ in _ROW_ARROW]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = scanner.scan(text.as_py() or "")
                x = scanner.best(found)
                row = (doc, *(x or (None, 0.0, 0, None, None)), len(found), ",".join(sorted({f[0] for f in found})))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW_ARROW, strict=True)], schema=_ROW_ARROW)

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its best notice (null if none), coverage, place, and all notices found. One narrow pass."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_scan(templates or NOTICES, coverage), _ROW)
