"""License scans by patience alignment.

A text and a template are word sequences. Words that occur once in both are anchors; the longest
increasing subsequence of their positions keeps the order of both, and the gaps between anchors
are aligned the same way, until a gap has no anchor; equal words at its ends still match. The
matched words over the words of the template are its coverage.

Each occurrence is looked for by itself: around every place where a word from the template's own
rare words stands, windows are aligned that slide over the stretch, narrow ones first and then up to
4.5 times the template's length, so that a notice is found whole though foreign words stand between
its own (line numbers, comment signs, a second column). A notice stretched out further is not found.
With a coverage of at least ``coverage`` some of any ``n - ceil(coverage * n) + 1`` words of
the template must occur, so texts without any of them are passed over at the cost of a search.

A template whose relative's text would pass as well needs its own words too (``nc``, the version),
a short notice all words that name its license, and ``lesser`` or ``affero`` inside a name make it
another one. Of occurrences that share most words the one with most matched words stays; ties go to
the better coverage, then to the earlier template.

Null texts count as empty and hold no license. Repeated rows and null ids give rows of their own;
an empty table gives no rows. Work per text grows with its words near a license.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from billscope.llm.common import documents, each_row, map_batches

def gnu_header(license: str, version: str, program: str) -> str:
    """The notice that the GNU licenses ask to put at the head of each file."""
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published"
        f" by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"
        f" of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details. You should have received"
        f" a copy of the GNU {license} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


# Public license notices, in their usual wording.
BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
        " specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "Licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": gnu_header("General Public License", "3", "This program"),
    "GPL-2.0": "Licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later": gnu_header("General Public License", "2", "This program"),
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later": gnu_header("Lesser General Public License", "3", "This library"),
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-or-later": gnu_header("Lesser General Public License", "2.1", "This library"),
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-or-later": gnu_header("Affero General Public License", "3", "This program"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software. THE"
        " SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
        " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED"
        " \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
        " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
        " SOFTWARE."
    ),
    "BSD-2-Clause": BSD_START + BSD_END,
    "BSD-3-Clause": BSD_START + BSD_NAMES + BSD_END,
}
#: Words of a short notice that name no license; all its other words have to be there.
PLAIN = {"licensed", "released", "under", "the", "license", "version", "general", "public"}
#: A notice is short up to this many words.
SHORT = 20
#: Words that make another license of a name when they stand inside it.
TURNING = {"lesser", "library", "affero", "documentation"}
#: Windows of so many template lengths are aligned, until one covers enough.
WINDOWS = (1.5, 2.5, 4.5)
WORD = re.compile(r"[\w.\-]*\w")
VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)?)")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words in lower case with their starts and ends; versions read alike (``4.0``, ``v4`` and ``4``)."""
    found = list(WORD.finditer(text))
    words = [m[0].lower() for m in found]
    for i, w in enumerate(words):
        if w[-1] in "0123456789" and (m := VERSION.fullmatch(w)):
            words[i] = m[1].removesuffix(".0")
    return words, [m.start() for m in found], [m.end() for m in found]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in text, in template), increasing in both."""
    matched: list[tuple[int, int]] = []
    open_ = [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1 and here.get(w) == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place])
        matched += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of increasing second members, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int | None] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        before.append(piles[at - 1] if at else None)
        if at == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[at], piles[at] = j, n
    found, n = [], piles[-1] if piles else None
    while n is not None:
        found.append(pairs[n])
        n = before[n]
    return found[::-1]


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words_of(text)[0]
        self.least = math.ceil(coverage * len(self.words))
        self.counts = Counter(self.words)
        #: Positions that have to be matched: what names the license, and its version.
        self.must = {
            i for i, w in enumerate(self.words)
            if (len(self.words) <= SHORT and w not in PLAIN) or (w[0].isdigit() and i and self.words[i - 1] in ("version", "v"))
        }
        #: Words that a near relative lacks, for each relative: lists of positions in the template.
        self.telling: list[list[int]] = []
        seen = self.counts
        # the longest words are the rarest in prose; some of these must occur, repeated words counted
        self.rare: set[str] = set()
        left = len(self.words) - self.least + 1
        for w in sorted(seen, key=lambda w: (-len(w), w)):
            if left <= 0:
                break
            self.rare.add(w)
            left -= seen[w]

    def tell_from(self, others: list[Template], coverage: float) -> None:
        """Take the words that set this template apart from those whose text could pass for it."""
        for other in others:
            own = Counter(self.words) - Counter(other.words)
            if own and len(self.words) - own.total() >= self.least:
                self.telling.append([i for i, w in enumerate(self.words) if w in own])
        self.coverage = coverage

    def told(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the match means this license and no relative.

        All words that name it and enough of those that set it apart from each relative are matched (of up
        to four, all), and no turning word stands where the template has two words in a row.
        """
        at = {j for _, j in pairs}
        if not self.must <= at:
            return False
        for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False):
            if m == j + 1 and k > i + 1 and not TURNING.isdisjoint(words[i + 1 : k]):
                return False
        return all(len(at.intersection(own)) >= math.ceil(self.coverage * len(own)) for own in self.telling)

    def scan(self, words: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Matched (word, word of the template) of each occurrence."""
        reach = math.ceil(max(WINDOWS) * len(self.words))
        stretches: list[list[int]] = []
        for i, w in enumerate(words):
            if w in self.rare:
                low, high = max(0, i - reach), min(len(words), i + reach + 1)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
        for low, high in stretches:
            while high - low >= self.least:
                pairs = self.tight(words[low:high])
                if not pairs:
                    break
                pairs = [(low + i, j) for i, j in pairs]
                if self.told(words, pairs):
                    yield pairs
                low = pairs[-1][0] + 1

    def tight(self, words: list[str]) -> list[tuple[int, int]]:
        """The alignment of the first window that covers enough: narrow windows first, then wider ones.

        Only windows that hold enough of the template's words, in any order, are aligned, and the words
        of a window are kept by counts that move along with it. A window that covers enough moves on
        while its neighbours cover more, and then grows on both sides until nothing more is matched.
        """
        step = max(1, len(self.words) // 4)
        for factor in WINDOWS:
            span = max(len(self.words) + 4, int(factor * len(self.words)))
            held: Counter = Counter()
            shared, filled = 0, 0
            best: list[tuple[int, int]] = []
            for start in range(0, max(1, len(words) - self.least + 1), step):
                end = min(len(words), start + span)
                for w in words[filled:end]:
                    if w in self.counts:
                        held[w] += 1
                        shared += held[w] <= self.counts[w]
                filled = end
                if start:
                    for w in words[start - step : start]:
                        if w in self.counts:
                            shared -= held[w] <= self.counts[w]
                            held[w] -= 1
                pairs = align(words[start:end], self.words) if shared >= max(self.least, len(best)) else []
                if len(pairs) >= self.least and len(pairs) > len(best):
                    best, first, last = [(i + start, j) for i, j in pairs], start, end
                elif best:
                    break
                if len(best) == len(self.words):
                    break
            for left, right in ((0, len(self.words)), (len(self.words), 0)):
                while best and len(best) < len(self.words) and (first > 0 if left else last < len(words)):
                    wide = max(0, first - left), min(len(words), last + right)
                    pairs = align(words[slice(*wide)], self.words)
                    if len(pairs) <= len(best):
                        break
                    first, last = wide
                    best = [(i + first, j) for i, j in pairs]
            if best:
                return best
        return []


def prepared(templates: dict[str, str], coverage: float) -> list[Template]:
    known = [Template(n, t, coverage) for n, t in templates.items()]
    for t in known:
        t.tell_from([o for o in known if o is not t], coverage)
    return known


def apart(found: list[tuple[Template, list[tuple[int, int]]]]) -> list[tuple[Template, list[tuple[int, int]]]]:
    """Of occurrences that share over half of the shorter one's words, the one with most matched words, then best coverage.

    Most words come first: a short notice lies whole in a longer one that lacks a word.
    """
    kept: list[tuple[Template, set[int], list[tuple[int, int]]]] = []
    for t, pairs in sorted(found, key=lambda x: (-len(x[1]), -len(x[1]) / len(x[0].words))):
        here = {i for i, _ in pairs}
        if all(2 * len(here & other) <= len(here) for _, other, _ in kept):
            kept.append((t, here, pairs))
    return [(t, pairs) for t, _, pairs in kept]


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, license, coverage, start and end (code points) of each occurrence in every whole text."""

    def work(batches: Iterator[pa.RecordBatch]):
        known = prepared(templates or TEMPLATES, coverage)
        rare = set().union(*(t.rare for t in known))
        any_rare = ahocorasick.Automaton()
        for w in rare:
            any_rare.add_word(w, w)
        any_rare.make_automaton()
        for doc, text in each_row(batches):
            if next(any_rare.iter(text.lower()), None) is None:
                continue
            words, starts, ends = words_of(text)
            present = set(words)
            found = [(t, pairs) for t in known if not t.rare.isdisjoint(present) for pairs in t.scan(words)]
            for t, pairs in apart(found):
                yield doc, t.name, round(len(pairs) / len(t.words), 6), starts[pairs[0][0]], ends[pairs[-1][0]]

    return map_batches(
        documents(docs, id_column, text_column), work, "doc_id long, license string, coverage double, start long, end long"
    )
