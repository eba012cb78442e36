"""Licence texts in documents by the Dice coefficient over word bigrams.

Text and templates are normalised alike: ASCII letters to lower case, words of
ASCII letters, digits and other than ASCII characters. Templates are few and
short, so their bigrams travel with the code; documents are passed over once.

Stretches of words whose neighbours are all bigrams of one template are its runs.
A region goes from the start of a run to the end of that or a later one, over
whatever words lie between and wherever lines break, with at most as many words as
the size bounds allow for that template; it matches when the Dice coefficient of
the two sets of bigrams reaches the threshold. Starts whose window holds too few
of a template's bigrams for that are passed over, so common pairs of words cost
nothing and a long template only counts where most of it stands. Of matching
regions that overlap, the one with most bigrams inside its template less those
outside comes first; the words it does not hold go on to the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.text import Words, gram_hashes, pieces

THRESHOLD = 0.8

# Public licence texts and notices.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD-3-Clause-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        'with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN "
        "NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details. You should have received a copy of the GNU Lesser General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty. You should have "
        "received a copy of the CC0 Public Domain Dedication along with this software. If not, see "
        "<http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}

_split = np.ones(256, dtype=bool)
_split[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Index:
    """Templates as sets of bigram hashes, by name, with their size bounds."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        names = sorted(templates)
        words = Words(pa.array([templates[n] for n in names], pa.string()), _split, lower=True)
        g, owner = gram_hashes(words.hashes(), 2), words.owner()
        sets = [np.unique(g[(owner[:-1] == t) & (owner[1:] == t)]) for t in range(len(names))]
        used = [t for t in range(len(names)) if len(sets[t])]
        self.names, self.sets = [names[t] for t in used], [sets[t] for t in used]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        # 2 |A & B| >= t (|A| + |B|) needs the smaller set to hold t / (2 - t) of the larger, in common.
        larger = (2 - threshold) / threshold
        self.needed = np.ceil(self.sizes / larger - 1e-9).astype(np.int64)
        #: Words of a template's longest region.
        self.longest = (words.counts[used] * larger + 1e-9).astype(np.int64) + 1 if used else np.zeros(0, np.int64)
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        #: Of each bigram, the templates that have it.
        self.member = np.stack([np.isin(self.all, s) for s in self.sets], axis=1) if self.names else np.zeros((0, 0), bool)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.all >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, templates) of the bigrams that some template has."""
        at = np.flatnonzero(self.filter[(g >> np.uint64(48)).astype(np.int64)])
        number = np.searchsorted(self.all, g[at])
        there = np.flatnonzero(number < len(self.all))
        there = there[self.all[number[there]] == g[at[there]]]
        return at[there], self.member[number[there]]

    def matches(self, t: int, g: np.ndarray, at: np.ndarray, ends: np.ndarray):
        """(score, Dice, first bigram, last bigram) of all matches of one template.

        ``at`` are the places of its bigrams, ``ends`` the last bigram of the text each of them lies in.
        """
        fresh = np.concatenate(([0], np.flatnonzero((np.diff(at) != 1) | (np.diff(ends) != 0)) + 1, [len(at)]))
        start, stop = at[fresh[:-1]], at[fresh[1:] - 1]
        limit = np.minimum(start + self.longest[t] - 2, ends[fresh[:-1]])
        held = np.searchsorted(at, limit, side="right") - fresh[:-1]
        for k in np.flatnonzero(held >= self.needed[t]).tolist():
            s = start[k]
            last = int(np.searchsorted(start, limit[k], side="right"))
            to = np.minimum(stop[k:last], limit[k])  # a run that goes on beyond the bound is cut there
            window = g[s : to[-1] + 1]
            _, first = np.unique(window, return_index=True)
            new, hit = np.zeros(len(window), np.int64), np.zeros(len(window), bool)
            new[first] = 1
            hit[at[fresh[k] : np.searchsorted(at, to[-1], side="right")] - s] = True
            n, common = np.cumsum(new)[to - s], np.cumsum(new * hit)[to - s]
            dice = 2 * common / (n + self.sizes[t])
            for m in np.flatnonzero(dice >= self.threshold).tolist():
                yield int(2 * common[m] - n[m]), float(dice[m]), int(s), int(to[m])


def _regions(batch: pa.RecordBatch, index: Index):
    """(row, first line, last line, first word, end, Dice, name) of the best disjoint matches of a batch."""
    words = Words(batch.column("text"), _split, lower=True)
    if len(words) < 2:
        return
    g, owner = gram_hashes(words.hashes(), 2), words.owner()
    at, templates = index.hits(g)
    within = owner[at] == owner[at + 1]
    at, templates = at[within], templates[within]
    found = []
    for t in np.flatnonzero(templates.any(axis=0)).tolist():
        mine = at[templates[:, t]]
        for score, dice, a, b in index.matches(t, g, mine, words.first[owner[mine] + 1] - 2):
            found.append((-score, -dice, b - a, a, b, t))
    if not found:
        return
    newlines = np.concatenate(([0], np.cumsum(words.data == 10)))
    taken = np.zeros(len(words), bool)
    for _, dice, _, a, b, t in sorted(found):
        if not taken[a : b + 2].any():
            taken[a : b + 2] = True
            row = int(owner[a])
            lines = newlines[words.starts[[a, b + 1]]] - newlines[words.offsets[row]]
            yield row, *lines.tolist(), int(a - words.first[row]), int(b + 2 - words.first[row]), -dice, index.names[t]


def read_templates(spark, path: str) -> dict[str, str]:
    """Templates from a folder of texts, a file each and named after it, to be used beside or instead of TEMPLATES."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt)?$", 1).alias("name"), "value")
    return {r.name: r.value for r in rows.collect()}


def find_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, from_line, to_line (from 0, last included), from_word, to_word (end exclusive), licence, dice of every match.

    Documents without a match, with null or empty text give no row. Matches of a
    document share no word; of several for the same words the one with the
    higher score counts (bigrams inside less those outside), then the larger coefficient,
    the shorter region, the first one, the first name. Repeated rows give repeated matches; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((templates, threshold))

    def found(batches):
        index = Index(*shared.value)
        for whole in batches:
            for batch in pieces(whole):
                rows = list(_regions(batch, index))
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        *(pa.array([r[i] for r in rows], pa.int32()) for i in range(1, 5)),
                        pa.array([r[6] for r in rows], pa.string()),
                        pa.array([r[5] for r in rows], pa.float64()),
                    ],
                    names=["doc_id", "from_line", "to_line", "from_word", "to_word", "licence", "dice"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        found, "doc_id bigint, from_line int, to_line int, from_word int, to_word int, licence string, dice double"
    )
