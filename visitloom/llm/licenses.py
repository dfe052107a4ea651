"""Find license texts by patience alignment with templates.

A text's words that occur in a template fall into regions: stretches in which template words follow
each other within GAP words. In a region, words that occur once there and once in the template are anchors;
the longest increasing subsequence of their places is kept, and the gaps between
neighbouring anchors are aligned in the same way. A gap without such a word is aligned by equal words from its
front and back. Coverage is the share of the template's words that are aligned. A region may
be cut where the template's opening words come again; the cuts that align the most words in notices are taken.
Regions too short by themselves whose aligned places in the template go on one after the other are fragments of
one notice, whatever stands between them. Texts of any length are scanned whole.

Defined cases: null and empty texts have no match. Ties go to the longer, then the first template by name.
Repeated ids are scanned row by row. Other columns are kept out of the result.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from visitloom.llm.common import folded, from_texts

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)?")
GAP = 6
MIN_COVERAGE = 0.8
MIN_WORDS = 3
PIECE = 5                      # aligned words of a fragment

# Wording of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."),
    "reserved": "All rights reserved.",
}


def words(text: str) -> list[str]:
    return folded(WORD, text)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first number, whose second numbers increase (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = []
    for n, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            ends.append(n)
        else:
            tops[pile], ends[pile] = b, n
        back.append(ends[pile - 1] if pile else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: n for n, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(n, place[w]) for n, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.templates = {n: words(t) for n, t in sorted(templates.items(), key=lambda x: (-len(words(x[1])), x[0]))}
        self.sets = {n: set(w) for n, w in self.templates.items()}
        self.counts = {n: Counter(w) for n, w in self.templates.items()}
        self.all = set().union(*self.sets.values())
        self.min_coverage = min_coverage

    def _regions(self, found: list[str], vocabulary: set[str]) -> Iterator[tuple[int, int]]:
        start = last = None
        for n, w in enumerate(found):
            if w in vocabulary:
                if last is not None and n - last > GAP:
                    yield start, last + 1
                    start = n
                elif last is None:
                    start = n
                last = n
        if last is not None:
            yield start, last + 1

    def _notices(self, region: list[str], template: list[str], need: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(start, aligned places) of each notice in a region.

        A region may be cut before the template's opening words, but need not be, as a template may hold
        them again. Of all ways to cut, the one with the most aligned words in notices is taken.
        """
        cuts = [0, *[n for n in range(1, len(region) - 1) if region[n: n + 2] == template[: 2]]]
        ends = [*cuts[1:], len(region)]
        best: list[tuple] = [(0, 0, None)] * (len(cuts) + 1)          # aligned words up to a cut, cut before, places
        for i, s in enumerate(cuts):
            if best[i][0] >= best[i + 1][0]:
                best[i + 1] = best[i][0], i, None
            most = idle = 0
            for j in range(i, len(cuts)):
                pairs = align(region[s: ends[j]], template)
                if len(pairs) >= need and best[i][0] + len(pairs) > best[j + 1][0]:
                    best[j + 1] = best[i][0] + len(pairs), i, pairs
                # parts that align nothing more, longer than the template, end the notice
                idle = 0 if len(pairs) > most else idle + ends[j] - cuts[j]
                most = max(most, len(pairs))
                if most == len(template) or idle > len(template):
                    break
        j = len(cuts)
        while j:
            _, i, pairs = best[j]
            if pairs:
                yield cuts[i], pairs
            j = i

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first character, past character), no two overlapping."""
        spans = [m.span() for m in WORD.finditer(text)]
        found = words(text)
        if self.all.isdisjoint(found):
            return []
        held = Counter(w for w in found if w in self.all)
        matches = []
        for name, template in self.templates.items():
            need = self.min_coverage * len(template)
            if sum(min(held[w], n) for w, n in self.counts[name].items()) < need:
                continue
            for places in self._matches(found, name, template, need):
                matches.append((len(places), len(places) / len(template), name, places[0], places[-1] + 1))
        out, taken = [], []
        for n, coverage, name, s, e in sorted(matches, key=lambda m: (-m[1] * m[0], -m[0], m[2], m[3])):
            i = bisect(taken, (s, e))
            if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or taken[i][0] >= e):
                taken.insert(i, (s, e))
                out.append((name, coverage, spans[s][0], spans[e - 1][1], s))
        return [m[:4] for m in sorted(out, key=lambda m: m[4])]

    def _matches(self, found: list[str], name: str, template: list[str], need: float) -> Iterator[list[int]]:
        """The aligned word places of each notice of one template.

        A region that is too short by itself is a fragment if PIECE of its words align. Fragments whose places in the
        template go on one after the other make one notice, however many foreign words stand between them.
        """
        chain: list[tuple[int, int]] = []             # (place in the text, place in the template)
        for s, e in self._regions(found, self.sets[name]):
            region = found[s:e]
            if e - s < MIN_WORDS:
                continue
            have, whole = Counter(region), False
            common = sum(min(have[w], n) for w, n in self.counts[name].items())
            if e - s >= max(MIN_WORDS, need) and common >= need:
                for at, pairs in self._notices(region, template, need):
                    whole = True
                    yield [s + at + x for x, _ in pairs]
            if whole:
                chain = []
            elif common >= PIECE:
                last = chain[-1][1] + 1 if chain else 0
                rest = [(s + x, last + y) for x, y in align(region, template[last:])] if chain else []
                fresh = [(s + x, y) for x, y in align(region, template)]
                if len(rest) >= PIECE:
                    chain = chain + rest
                elif len(fresh) >= PIECE:
                    chain = fresh
                if len(chain) >= max(MIN_WORDS, need):
                    yield [x for x, _ in chain]
                    chain = []


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_notices, license and coverage of the best match, and all notices with their characters."""
    def make():
        scanner = Scanner(templates, min_coverage)

        def judge(texts: list) -> list[tuple]:
            rows = []
            for t in texts:
                found = scanner.scan(t) if t else []
                best = max(found, key=lambda m: m[1], default=(None, 0.0))
                rows.append((len(found), best[0], float(best[1]), [dict(zip(("license", "coverage", "start", "past"), m)) for m in found]))
            return rows
        return judge
    return from_texts(docs.select("doc_id", "text"), ["doc_id"], make,
                      "n_notices long, license string, coverage double, notices array<struct<license: string, coverage: double, start: long, past: long>>")
