"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Texts are lower-cased words. A fingerprint is the hash of ``GRAM`` words in a row; of every ``WINDOW``
fingerprints in a row the least is kept, so any run of ``GRAM + WINDOW - 1`` words that a text shares with
a template leaves a common fingerprint. Words that no template has cannot start a match: fingerprints with such words
rank last. Fingerprints are this dense because notices may be as short as three words. The inverted index gives (template, place) for each kept fingerprint; hits of a template near one diagonal
form a candidate once they hold ``LEAST_HITS`` of its fingerprints, and the template is then aligned with the words
around that diagonal. Hits that follow each other within ``CHAIN_GAP`` words but drift over many diagonals, as words were put into
the notice, form a candidate with a band as wide as the drift, at most as wide as the template is long. A match holds at least ``COVERAGE`` of the template's words, in order. Of matches that share words of the
document the one with more matched words stays (then higher coverage, earlier place, smaller name).

Null and empty texts match nothing. Repeated notices are reported each with their own span.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, append_struct

GRAM, WINDOW = 2, 2
LEAST_HITS = 0.25
COVERAGE = 0.8
BAND = 16
#: Words between neighbouring hits of a chain, at most.
CHAIN_GAP = 64
#: What a word more or less costs; less than 1 / 3, so that a notice with a word put in after every second one still adds up.
GAP = 0.3

#: Texts of common license notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "Unlicense-body": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "All-rights-reserved": "All rights reserved.",
}

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed fingerprints of word numbers (0: a word that no template has)."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(GRAM):
        part = ids[j : j + n]
        known &= part > 0
        h = (h + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h[~known] = _LAST
    if n <= WINDOW:
        kept = np.array([n - 1 - int(h[::-1].argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1]
        kept = np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))
    kept = kept[h[kept] != _LAST]
    return kept, h[kept]


def align(template: list[int], words: list[int], centre: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, first and last matched place in ``words`` of the best alignment near the diagonal ``centre``.

    Global in the template, local in ``words``: a match gains one, a gap costs ``GAP``.
    """
    n, width = len(template), 2 * band + 1
    none = (0.0, 0, -1, -1)
    last: list[tuple[float, int, int, int]] = [none] * width
    best = none
    for i in range(n):
        row: list[tuple[float, int, int, int]] = []
        for b in range(width):
            j = i + centre - band + b
            score, hits, first, end = last[b]  # the template's word and the document's word, matched or not
            here = (score - GAP, hits, first, end)
            if 0 <= j < len(words) and words[j] == template[i]:
                here = (score + 1, hits + 1, j if first < 0 else first, j)
            if b + 1 < width and (above := last[b + 1])[0] - GAP > here[0]:  # the template's word is missing
                here = (above[0] - GAP, *above[1:])
            if b and (left := row[b - 1])[0] - GAP > here[0]:  # the document has a word more
                here = (left[0] - GAP, *left[1:])
            row.append(here if here[0] > 0 else none)
            if here[0] > best[0]:
                best = here
        last = row
    return best[1], best[2], best[3]


class LicenseIndex:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(n for n, t in templates.items() if WORD.findall(t.lower()))
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(templates[n].lower())] for n in self.names]
        found = [(int(h), k, int(p)) for k, words in enumerate(self.words) for p, h in zip(*fingerprints(np.array(words)), strict=True)]
        found.sort()
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.template, self.place = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        sizes = np.bincount(self.template, minlength=len(self.names)) if found else np.zeros(len(self.names), int)
        self.least = np.maximum(1, np.floor(LEAST_HITS * sizes)).astype(int)
        #: One-word templates have no fingerprint; their word is looked up as it is.
        self.single = {words[0]: k for k, words in enumerate(self.words) if len(words) < GRAM}

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, diagonal, band around it) to align."""
        out = {(k, int(at), BAND) for w, k in self.single.items() for at in np.flatnonzero(ids == w)}
        places, hashes = fingerprints(ids)
        low, high = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, "right")
        many = high - low
        if not many.any():
            return out
        entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        where, template, place = np.repeat(places, many), self.template[entry], self.place[entry]
        diagonal = where - place
        # Two overlapping grids of diagonals, so that near ones share a cell of one of them.
        for offset in (0, BAND // 2):
            cell = np.floor_divide(diagonal + offset, BAND)
            rows = np.unique(np.column_stack([template, cell, place]), axis=0)
            pairs, counts = np.unique(rows[:, :2], axis=0, return_counts=True)
            out |= {(int(t), int(c) * BAND - offset + BAND // 2, BAND) for (t, c), n in zip(pairs, counts, strict=True) if n >= self.least[t]}
        return out | self.chains(template, where, place)

    def chains(self, template: np.ndarray, where: np.ndarray, place: np.ndarray) -> set[tuple[int, int, int]]:
        """Candidates whose hits drift over more diagonals than a band has, as words are put into the notice: the band is as wide as the drift."""
        out = set()
        order = np.lexsort((place, where, template))
        template, where, place = template[order], where[order], place[order]
        for part in np.split(np.arange(len(template)), np.flatnonzero((np.diff(template) != 0) | (np.diff(where) > CHAIN_GAP)) + 1):
            k = int(template[part[0]])
            diagonal, size = where[part] - place[part], len(self.words[k])
            drift = int(diagonal.max() - diagonal.min())
            if size > BAND < drift and len(np.unique(place[part])) >= 2 * self.least[k]:
                out.add((k, int(diagonal.min() + diagonal.max()) // 2, min(size, drift // 2 + BAND)))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start and end character) of every match, in order of place."""
        if not text:
            return []
        # Lower-casing may change lengths; spans then refer to the words of the text as it is.
        lowered = text.lower()
        get = self.vocabulary.get
        found = WORD.findall(lowered)
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        todo = self.candidates(ids)
        if not todo:
            return []
        words, matches = ids.tolist(), []
        for k, centre, band in sorted(todo):
            size = len(self.words[k])
            begin = max(0, centre - band)
            region = words[begin : centre + size + band + 1]
            while True:  # short notices may repeat within a band
                n, first, last = align(self.words[k], region, centre - begin, band)
                if not n or n < COVERAGE * size:
                    break
                matches.append((-n, -n / size, begin + first, self.names[k], begin + last))
                region[first : last + 1] = [0] * (last + 1 - first)
        taken, out = np.zeros(len(words), bool), []
        spans = [m.span() for m in WORD.finditer(text)] if matches else []
        if matches and len(spans) != len(words):
            spans = [m.span() for m in WORD.finditer(lowered)]
        for less, cover, first, name, last in sorted(set(matches)):
            if not taken[first : last + 1].any():
                taken[first : last + 1] = True
                out.append((name, -cover, -less, spans[first][0], spans[last][1]))
        return sorted(out, key=lambda x: (x[3], x[0]))


MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_NAMES = ("license", "coverage", "words", "start", "end")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text", into: str = "licenses") -> DataFrame:
    """Adds the struct ``into`` whose array ``found`` has a license, its coverage and its span for every match; narrow, no shuffle."""

    def make():
        index = LicenseIndex(templates)
        return lambda texts: [pa.array([[dict(zip(_NAMES, m, strict=True)) for m in index.scan(t)] for t in texts], _ARROW)]

    return append_struct(docs, text_col, [T.StructField("found", MATCHES)], into, make)
