"""License scans by patience alignment.

A text and a template are sequences of words (letters, digits, inner dots and hyphens, in lower case). The template is
aligned with a stretch of the text: words that occur once in both are anchors, the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned the same way, where words that occur more often may have become
unique. A gap without anchors keeps the longest increasing subsequence of the places of all its equal words. Coverage is the share
of the template's words that the alignment matches, and the statement begins at its first match.

Which stretches: a chain is a sequence of template words that the text holds in the template's order, with at most `gap` other words
between two that follow each other (if not given as many as the template has words, and 2 * SLACK more; math.inf sets no bound). How
long it gets in all is not bounded, so copyright lines, remarks and line numbers inside a statement do not hide it. At a coverage of
LIMIT at most n - ceil(LIMIT n) of the n template words are unmatched, so of any one more words one is matched. The words rarest in
the text are taken, and each of their occurrences fixes the span that a chain through it can reach; spans that meet are joined. In
each, the longest chain for every first word is found exactly; where none reaches the limit, there is nothing to align. The others are
aligned, the longest first, until no chain left is longer than the best alignment. An anchor that the text holds out of place can cost the
alignment words that a chain has; then the alignment counts.

A license is reported when its coverage is at least LIMIT. Null and empty texts report nothing. Repeated rows are scanned each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import piece_of, pieces

LIMIT = 0.8
SLACK = 4
WORD = re.compile(rb"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

# fixed values: short forms, notices and texts of public licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                         "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                         'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
                         "for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
                    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
                    "ARE DISCLAIMED.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                      "later version.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                  "provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
                  "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                  "persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
                "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
                'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
                "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
                "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
                "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# end of the fixed values


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], []
    for i, place in enumerate(places):
        k = bisect.bisect_left(tops, place)
        if k == len(tops):
            tops.append(place)
            piles.append(i)
        else:
            tops[k], piles[k] = place, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Places (text, template) matched by patience alignment of the two sequences, in order."""
    pairs, waiting = [], [(0, len(text), 0, len(template))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        at: dict[bytes, list[int]] = {}
        for j in range(d - 1, c - 1, -1):
            at.setdefault(template[j], []).append(j)
        here = Counter(w for w in text[a:b] if w in at)
        once = {w for w, places in at.items() if len(places) == 1 and here[w] == 1}
        anchors = [(i, j) for i in range(a, b) if text[i] in (once or at) for j in at[text[i]]]
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        pairs += kept
        if once:
            for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
                waiting.append((i + 1, k, j + 1, m))
    return sorted(pairs)


def matched_words(text: list[bytes], template: list[bytes]) -> int:
    return len(aligned(text, template))


class Template:
    def __init__(self, name: str, text: str, gap: float | None = None):
        self.name, self.words = name, words_of(text.encode())
        self.counts = Counter(self.words)
        self.need = math.ceil(LIMIT * len(self.words))
        self.gap = len(self.words) + 2 * SLACK if gap is None else gap
        self.at: dict[bytes, list[int]] = {}
        for j, word in enumerate(self.words):
            self.at.setdefault(word, []).append(j)

    def spans(self, places: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """Disjoint ranges of the text, in order, that hold every chain of `need` words."""
        if self.gap == math.inf:
            return [(0, max(x[-1] for x in places.values()))] if places else []
        spare = len(self.words) - self.need + 1
        rarest = sorted(range(len(self.words)), key=lambda j: (len(places.get(self.words[j], ())), j))[:spare]
        step, out = self.gap + 1, []
        for a, b in sorted((i - j * step, i + (len(self.words) - 1 - j) * step) for j in rarest for i in places.get(self.words[j], ())):
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out

    def chains(self, found: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
        """(words, first place, last place) of the chains that reach the limit among the (place, word) in order of place: for every first
        place the one with most words, then the shortest. `top` holds for every template word the best chain (words, first place) that
        ends there and can still go on."""
        none = (0, -1)
        top, ends, recent = [none] * len(self.words), [deque() for _ in self.words], deque()
        best: dict[int, tuple[int, int]] = {}
        for i, word in found:
            while recent and recent[0][0] < i - self.gap - 1:
                place, j = recent.popleft()
                if ends[j][0][0] == place:
                    ends[j].popleft()
                    top[j] = ends[j][0][1] if ends[j] else none
            new = []
            for j in self.at[word]:
                n, first = max(top[:j], default=none)
                new.append((j, (n + 1, first if n else i)))
            for j, value in new:
                while ends[j] and ends[j][-1][1] <= value:
                    ends[j].pop()
                ends[j].append((i, value))
                top[j] = ends[j][0][1]
                recent.append((i, j))
                n, first = value
                if n >= self.need and n > best.get(first, none)[0]:
                    best[first] = n, i
        return [(n, first, last) for first, (n, last) in best.items()]

    def candidates(self, places: dict[bytes, list[int]]) -> list[tuple[int, int, int]]:
        """The chains of a text that reach the limit: most words, then shortest, then first."""
        if sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items()) < self.need:
            return []
        out = []
        for a, b in self.spans({w: places[w] for w in self.counts if w in places}):
            held = {w: places[w][bisect.bisect_left(places[w], a):bisect.bisect_right(places[w], b)] for w in self.counts if w in places}
            if sum(min(self.counts[w], len(x)) for w, x in held.items()) >= self.need:
                out += self.chains(sorted((i, w) for w, x in held.items() for i in x))
        return sorted(out, key=lambda c: (-c[0], c[2] - c[1], c[1]))

    def best(self, text: list[bytes], places: dict[bytes, list[int]]) -> tuple[int, int] | None:
        """(matched words, first word) of the best alignment at or above the limit."""
        found = None
        for n, first, last in self.candidates(places):
            if found and found[0] >= n:
                break
            pairs = aligned(text[first:last + 1], self.words)
            if len(pairs) >= self.need and (found is None or len(pairs) > found[0]):
                found = len(pairs), first + pairs[0][0]
        return found


def scan_text(data: bytes, templates: list[Template]) -> tuple[int, list[dict]]:
    """Number of words, and the licenses of a text by falling coverage, then name."""
    text = words_of(data)
    wanted = {w for t in templates for w in t.counts}
    places: dict[bytes, list[int]] = {}
    for i, word in enumerate(text):
        if word in wanted:
            places.setdefault(word, []).append(i)
    hits = []
    for t in templates:
        found = t.best(text, places)
        if found:
            hits.append({"license": t.name, "coverage": found[0] / len(t.words), "n_matched": found[0], "first_word": found[1]})
    return len(text), sorted(hits, key=lambda h: (-h["coverage"], -h["n_matched"], h["license"]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, gap: float | None = None) -> DataFrame:
    """doc_id, n_words, licenses (array of license, coverage, n_matched, first_word): one row for each row of `docs`.

    `gap` is the largest number of other words in one place of a statement (None: by the length of each template, math.inf: any).
    """
    chosen = templates or TEMPLATES

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(*x, gap) for x in sorted(chosen.items())]
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("first_word", pa.int64())]))
        for piece in pieces(batches, "text"):
            raw, at = piece_of(piece, "text")
            data = raw.tobytes()
            found = [scan_text(data[a:b], known) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([x for _, x in found], kind)], ["doc_id", "n_words", "licenses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(look, "doc_id long, n_words long, licenses array<struct<license:string,coverage:double,n_matched:long,first_word:long>>")
