"""Licence scans: Dice coefficients of word bigrams against licence templates.

Texts are normalised to lower-case runs of letters and digits. A template is
compared to all windows of a text's words that begin and end with a bigram of
the template (a longer window has a smaller coefficient), across and inside
lines. The Dice coefficient of two multisets of bigrams is at least t only if
the smaller has t / (2 - t) of the larger's size, which bounds windows; a
window is begun only where enough of the template's bigrams follow.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import NON_ALNUM, blocks, gram_hash, hash_of, words

#: Least Dice coefficient of a match.
LEAST = 0.8

#: (licence, text): notices and whole texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
]

#: Cells (window begun by window ended) that are compared at once.
CELLS = 1 << 20

_RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bigrams(text: str) -> Counter:
    """The multiset of word bigrams of the normalised text."""
    w = _RUN.findall(text.translate(_UPPER))
    return Counter(zip(w, w[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all bigrams; 0 if there are none."""
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        if not 0.5 <= least <= 1:
            raise ValueError("the least coefficient is 0.5 to 1")
        self.least = least
        self.all = sorted(((b.total(), name, b) for name, text in templates if (b := bigrams(text))), key=lambda x: x[:2])
        self.sizes = np.array([n for n, _, _ in self.all])
        hashes = [gram_hash(hash_of(" ".join(_RUN.findall(text.translate(_UPPER))), NON_ALNUM), 2) for _, text in templates]
        self.known = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known >> np.uint64(48)] = True
        #: A unit of m bigrams has a coefficient of t with one of n >= m / bound only if t * (m + n) / 2 are common.
        self.bound = least / (2 - least)
        #: (licence, size, how often each known bigram occurs, which of them each template lacks that is of another licence and has most)
        counts = [(name, np.bincount(np.searchsorted(self.known, g), minlength=len(self.known))) for (name, _), g in zip(templates, hashes, strict=True) if len(g)]
        self.each = [(name, int(c.sum()), c, [x == 0 for other, x in counts if other != name and c[x > 0].sum() >= self.need(int(c.sum()))]) for name, c in counts]

    def need(self, n: int) -> int:
        """A window of m >= n * bound bigrams that matches a template of n has t * (m + n) / 2 in common with it."""
        return max(1, int(np.ceil(self.least * n * (1 + self.bound) / 2 - 1e-9)))

    def best(self, unit: Counter) -> tuple[float, str] | None:
        """The best match of a unit, of equals the first by name."""
        n, found = unit.total(), None
        lo, hi = np.searchsorted(self.sizes, [np.ceil(n * self.bound - 1e-9), np.floor(n / self.bound + 1e-9) + 1])
        for _, name, b in self.all[lo:hi]:
            d = dice(unit, b)
            if d >= self.least and (found is None or (-d, name) < (-found[0], found[1])):
                found = d, name
        return found

    def scan(self, raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
        """(first line, last line, licence, Dice) of the matches of each text; those of one licence don't overlap."""
        w = words(raw, at, NON_ALNUM)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(len(at) - 1)]
        if len(w.hash) < 2 or not len(self.known):
            return out
        g = gram_hash(w.hash, 2)
        place = np.flatnonzero(self.maybe[g >> np.uint64(48)])
        which = np.minimum(np.searchsorted(self.known, g[place]), len(self.known) - 1)
        keep = (self.known[which] == g[place]) & (w.doc[place] == w.doc[place + 1])
        place, which = place[keep], which[keep]
        line_of_byte = np.cumsum(raw == 10)
        line = line_of_byte[w.start]
        new = np.ones(len(w.doc) + 1, bool)
        new[1:-1] = (w.doc[1:] != w.doc[:-1]) | (line[1:] != line[:-1])
        by_doc: dict[int, list[tuple[_Windows, int]]] = {}
        for name, n, count, lacks in self.each:
            mine = count[which] > 0
            x = _Windows(self, name, n, place[mine], which[mine], count, lacks, w.doc, new)
            for i in x.begin:
                by_doc.setdefault(int(w.doc[x.place[i]]), []).append((x, int(i)))
        base = np.concatenate([[0], line_of_byte])[at[:-1]]
        for d, begins in by_doc.items():
            out[d] = sorted((int(line[a] - base[d]), int(line[b] - base[d]), name, dice) for a, b, name, dice in _choose(begins))
        return out


class _Windows:
    """The windows that match one template; ``begin`` are the places that begin one."""

    def __init__(self, table: Templates, name: str, n: int, place: np.ndarray, which: np.ndarray, count: np.ndarray, lacks: list[np.ndarray], doc: np.ndarray, new: np.ndarray):
        self.least, self.name, self.n, self.place = table.least, name, n, place
        longest, need = int(n / table.bound + 1e-9), table.need(n)
        last = np.searchsorted(doc, doc[place], "right") if len(place) else place
        self.stop = np.searchsorted(place, np.minimum(place + longest, last))
        begin = np.flatnonzero(self.stop - np.arange(len(place)) >= need)
        self.begin = begin
        if not len(begin):
            return
        #: The place so many occurrences of the same bigram before that a window with both has one too many.
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], which[order])
        rank, back = np.arange(len(order)) - first, count[which[order]]
        self.before = np.full(len(place), -1)
        far = rank >= back
        self.before[order[far]] = order[np.flatnonzero(far) - back[far]]
        #: How many bigrams up to a place tell the template from each that has most of it; inside a line some must.
        self.told = [np.concatenate([[0], np.cumsum(x[which])]) for x in lacks]
        self.head, self.tail = new[place], new[place + 2]
        self.dice, self.end = np.zeros(len(place)), np.zeros(len(place), np.int64)
        width = int((self.stop[begin] - begin).max())
        for a in range(0, len(begin), max(1, CELLS // width)):
            some = begin[a : a + max(1, CELLS // width)]
            self.dice[some], self.end[some] = self.best(some, self.stop[some])
        self.begin = begin[self.dice[begin] > 0]

    def best(self, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest coefficient of windows from each of ``begin`` that end before ``stop`` (0 for none), and the last place of the longest such."""
        k = begin[:, None] + np.arange(max(1, int((stop - begin).max())))
        ok = k < stop[:, None]
        k = np.minimum(k, len(self.place) - 1)
        common = np.cumsum((self.before[k] < begin[:, None]) & ok, axis=1)
        dice = 2 * common / (self.place[k] - self.place[begin][:, None] + 1 + self.n)
        ok &= dice >= self.least - 1e-12
        lines = self.head[begin][:, None] & self.tail[k]
        for told in self.told:
            ok &= lines | (told[k + 1] > told[begin][:, None])
        dice = np.where(ok, dice, 0.0)
        at = dice.shape[1] - 1 - dice[:, ::-1].argmax(axis=1)
        row = np.arange(len(begin))
        return dice[row, at], k[row, at]


def _choose(begins: list[tuple[_Windows, int]]) -> list[tuple[int, int, str, float]]:
    """(first word, last word, licence, Dice) of the windows that count.

    Of overlapping windows of one licence the closest counts, then the longest,
    then the first; one that it cuts ends before it. A window that lies mostly
    in a closer one of another licence doesn't count.
    """

    def entry(x: _Windows, i: int, dice: float, end: int) -> tuple:
        first, last = int(x.place[i]), int(x.place[end]) + 1
        return -dice, first - last, first, x.name, next(turn), last, x, i

    turn, taken = itertools.count(), []
    queue = [entry(x, i, float(x.dice[i]), int(x.end[i])) for x, i in begins]
    heapq.heapify(queue)
    while queue:
        dice, _, first, name, _, last, x, i = heapq.heappop(queue)
        same = [(a, b) for a, b, n, _ in taken if n == name and a <= last and first <= b]
        if any(a <= first for a, _ in same):
            continue
        if same:
            stop = np.searchsorted(x.place, [min(a for a, _ in same) - 1])
            if stop[0] > i:
                d, end = x.best(np.array([i]), stop)
                if d[0] > 0:
                    heapq.heappush(queue, entry(x, i, float(d[0]), int(end[0])))
            continue
        if any(n != name and 2 * (min(b, last) - max(a, first) + 1) > last - first + 1 for a, b, n, _ in taken):
            continue
        taken.append((first, last, name, -dice))
    return taken


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, licence, dice, licences, matches.

    ``matches`` are (first_line, last_line, licence, dice) of the windows of
    words, across and inside lines, with a Dice coefficient of at least
    ``least`` (0.5 or more) with a template; two can be in one line;
    ``licence`` and ``dice`` are the best, of equals the first by name (null
    and 0 without any), ``licences`` all names in order. Null and empty texts
    match nothing; windows of fewer than two words have no bigrams. Repeated rows
    are each returned; only doc_id and text are read. Texts are whole.
    """
    table = Templates(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(1)):
                found = table.scan(raw, at)
                best = [min(((-d, name) for _, _, name, d in x), default=None) for x in found]
                matches = [[{"first_line": a, "last_line": b, "licence": name, "dice": d} for a, b, name, d in x] for x in found]
                kind = pa.list_(pa.struct([("first_line", pa.int64()), ("last_line", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array([b and b[1] for b in best], pa.string()), pa.array([-b[0] if b else 0.0 for b in best], pa.float64()),
                        pa.array([sorted({x[2] for x in f}) for f in found], pa.list_(pa.string())), pa.array(matches, kind),
                    ],
                    ["doc_id", "licence", "dice", "licences", "matches"],
                )

    schema = "doc_id long, licence string, dice double, licences array<string>, matches array<struct<first_line:long,last_line:long,licence:string,dice:double>>"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``."""
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "licence", F.round("dice", 9).alias("dice"), F.size("matches").cast("long").alias("n_matches"), F.array_join("licences", ",").alias("licences"))


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {}
