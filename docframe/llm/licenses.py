"""Licence scans: Dice coefficient over word bigrams against licence templates.

Units of a text are the whole text, its blocks (between blank lines) and its lines. A unit is
normalised to its runs of ASCII letters and digits in lower case; with A and B the sets of
bigrams of a unit and a template, Dice is 2 |A & B| / (|A| + |B|). Since |A & B| is at most the
smaller set, only templates of |A| t / (2 - t) to |A| (2 - t) / t bigrams can reach t; they are
the ones of a contiguous stretch of the templates in order of size, and only they are compared.

Licences that span units, or stand amid other words, are found as windows of a text's words,
against the templates and the full licence texts of ``license_texts``. A window has at least a
template's number of words, or is a run of whole lines; it may start at any word. Shorter cuts
do not count: they would leave out just the word that tells two notices apart. The best window
of a text counts, then the best of those that share no word with it, and so on; of equal ones that
of the template of more bigrams, then the first by name, then by place. A window goes if a unit that
shares words with it has the same licence. ``no`` of a window is the number of its first word.

A window that reaches t holds |B| t / (2 - t) bigrams of its template, and so does the text, which
leaves few texts and templates to search; of those all windows are compared, save ones that start
with a bigram that they repeat: without it they are the same set.

Defined results: null texts are empty; units of fewer than two words match nothing; a block that
is the whole text, and a line that is a whole block, count once, as the larger unit; of several
templates that reach the threshold the best one counts, of equal ones the first by name; texts of
any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

THRESHOLD = 0.8
#: Public licence texts, in the parts that templates share.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Fixed values: (licence, template). Public licence texts and the notices that refer to them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", f"{BSD_TERMS} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAME} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", f"{MIT_GRANT} {MIT_DISCLAIMER}"),
    ("MIT", MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
WORD = re.compile(r"[A-Za-z0-9]+")
BLANK = re.compile(r"\n[ \t\r]*\n")
SCHEMA = "unit string, no long, license string, dice double"


@lru_cache
def bodies() -> tuple[tuple[str, str], ...]:
    """(licence, full text) of the texts that lie beside this module."""
    found = [x for x in files(__package__).joinpath("license_texts").iterdir() if x.name.endswith(".txt")]
    return tuple(sorted((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in found))


def words_of(text: str) -> list[str]:
    return " ".join(WORD.findall(text)).lower().split()


def bigrams(text: str) -> set[tuple[str, str]]:
    words = words_of(text)
    return set(zip(words, words[1:]))


def units(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, number, text) of the whole text, then its blocks, then its lines."""
    yield "text", 0, text
    blocks = BLANK.split(text)
    if len(blocks) > 1:
        yield from (("block", i, b) for i, b in enumerate(blocks))
    lines, whole = text.split("\n"), {text, *blocks}
    yield from (("line", i, x) for i, x in enumerate(lines) if x not in whole)


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.sets = sorted(((name, bigrams(text)) for name, text in templates), key=lambda x: (len(x[1]), x[0]))
        self.sizes = [len(s) for _, s in self.sets]

    def best(self, grams: set) -> tuple[str, float] | None:
        t, n = self.threshold, len(grams)
        lo, hi = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        found = [(2.0 * len(grams & s) / (n + len(s)), name) for name, s in self.sets[lo:hi]] if n else []
        found = sorted((-d, name) for d, name in found if d >= t)
        return (found[0][1], -found[0][0]) if found else None


class _Text:
    """A text's bigrams by place: their numbers, and where each occurred before and occurs next."""

    def __init__(self, text: str):
        counts = [len(WORD.findall(x)) for x in text.split("\n")]
        words = words_of(text)
        self.numbers: dict[tuple[str, str], int] = {}
        ids = [self.numbers.setdefault(g, len(self.numbers)) for g in zip(words, words[1:])]
        self.ids, self.n = np.array(ids, np.int64), len(ids)
        self.before, self.after = np.full(self.n, -1, np.int64), np.full(self.n, self.n, np.int64)
        order = np.argsort(self.ids, kind="stable")
        same = self.ids[order[1:]] == self.ids[order[:-1]]
        self.before[order[1:][same]] = order[:-1][same]
        self.after[order[:-1][same]] = order[1:][same]
        borders = np.cumsum([0, *counts])
        #: whether a line starts with a bigram's first word, or ends with its second
        self.starts, self.ends = (np.isin(np.arange(self.n) + k, borders) for k in (0, 2))


class Windows:
    """Search for the windows of a text that reach the threshold."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.templates, self.holders = threshold, [], {}
        for name, text in templates:
            if grams := bigrams(text):
                for g in grams:
                    self.holders.setdefault(g, []).append(len(self.templates))
                self.templates.append((name, grams, len(words_of(text)) - 1))
        self.grams = set(self.holders)
        self.least = [max(1, math.ceil(len(g) * threshold / (2 - threshold) - 1e-9)) for _, g, _ in self.templates]

    def best(self, text: str, grams: set) -> list[tuple[int, int, str, float]]:
        """(first word, last word, licence, dice) of the windows that count; grams are those of text."""
        held = Counter()
        for g in grams & self.grams:
            held.update(self.holders[g])
        some = sorted(k for k, c in held.items() if c >= self.least[k])
        if not some:
            return []
        x = _Text(text)
        hits = {k: np.isin(x.ids, [x.numbers[g] for g in self.templates[k][1] if g in x.numbers]) for k in some}
        heap = []

        def offer(k: int, i: int, last: int) -> None:
            dice, j = self._from(x, hits[k], k, i, last)
            if dice >= self.threshold:
                heapq.heappush(heap, (-dice, -len(self.templates[k][1]), self.templates[k][0], i, j, k))

        for k in some:
            for i in self._starts(x, hits[k], k).tolist():
                offer(k, i, x.n - 1)
        taken: list[tuple[int, int, str, float]] = []
        while heap:
            dice, _, name, i, j, k = heapq.heappop(heap)
            at = bisect_right(taken, (i, math.inf))
            if at and taken[at - 1][1] >= i:
                continue
            if at < len(taken) and taken[at][0] <= j + 1:
                if taken[at][0] - 2 >= i:
                    offer(k, i, taken[at][0] - 2)
            else:
                insort(taken, (i, j + 1, name, -dice))
        return taken

    def _starts(self, x: _Text, hit: np.ndarray, k: int) -> np.ndarray:
        """Where windows of template k may start: at lines, at its bigrams, and where a window of
        its own length reaches the threshold; if enough of its bigrams follow."""
        _, grams, size = self.templates[k]
        start = x.starts | hit
        if x.n >= size:
            place = np.arange(x.n)

            def distinct(some: np.ndarray) -> np.ndarray:
                # a bigram counts for the windows that reach its place, but not its last one before
                lo = np.maximum(np.maximum(x.before + 1, place - size + 1), 0)[some]
                return np.cumsum(np.bincount(lo, minlength=x.n + 1) - np.bincount(place[some] + 1, minlength=x.n + 1))[: x.n - size + 1]

            start[: x.n - size + 1] |= 2.0 * distinct(hit) / (distinct(np.ones(x.n, bool)) + len(grams)) >= self.threshold
        start &= hit.sum() - (np.cumsum(hit) - hit) >= self.least[k]
        return np.flatnonzero(start)

    def _from(self, x: _Text, hit: np.ndarray, k: int, i: int, last: int) -> tuple[float, int]:
        """(dice, last bigram) of the best window that starts with bigram i and ends by bigram last."""
        _, grams, size = self.templates[k]
        most = len(grams) * (2 - self.threshold) / self.threshold + 1e-9
        last, reach = min(last, max(int(x.after[i]) - 1, i + size - 1)), size + size // 2 + 1
        while True:
            stop = min(last, i + reach)
            new = x.before[i : stop + 1] < i
            a = np.cumsum(new)
            if stop == last or a[-1] > most:
                break
            reach *= 2
        dice = 2.0 * np.cumsum(new & hit[i : stop + 1]) / (a + len(grams))
        short = slice(0, size - 1)
        dice[short] *= x.ends[i : stop + 1][short] & x.starts[i]
        at = int(np.argmax(dice))
        return float(dice[at]), i + at


def _spans(text: str, found: list[tuple[str, int, str, float]]) -> list[tuple[int, int, str]]:
    """(first word, one after the last, licence) of the units found in text."""
    parts = {"text": [text], "block": BLANK.split(text), "line": text.split("\n")}
    ends = {kind: np.cumsum([0, *(len(WORD.findall(p)) for p in parts[kind])]) for kind in {x[0] for x in found}}
    return [(int(ends[kind][no]), int(ends[kind][no + 1]), name) for kind, no, name, _ in found]


def scan(docs: DataFrame, templates=tuple(TEMPLATES), threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", texts=None) -> DataFrame:
    """(id, unit, no, license, dice) of every unit and window that reaches the threshold; ``texts``
    are the templates that only windows are compared with, ``bodies()`` by default."""
    texts = bodies() if texts is None else texts
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, windows = Matcher(list(templates), threshold), Windows([*templates, *texts], threshold)
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                found, whole = [], None
                for kind, no, part in units(text):
                    grams = bigrams(part)
                    whole = grams if whole is None else whole
                    if got := matcher.best(grams):
                        found.append((kind, no, *got))
                if more := windows.best(text, whole):
                    spans = _spans(text, found)
                    found += [("window", lo, name, dice) for lo, hi, name, dice in more if not any(a <= hi and lo < b and name == n for a, b, n in spans)]
                at += [i] * len(found)
                out += found
            kind, no, name, dice = zip(*out) if out else ((), (), (), ())
            ids = b.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kind, pa.string()), pa.array(no, pa.int64()), pa.array(name, pa.string()), pa.array(dice, pa.float64())], names=["id", "unit", "no", "license", "dice"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {SCHEMA}").withColumnRenamed("id", id_col)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for the rows of op8_licenses."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES)
    grams = lambda w: f"list_distinct([{w}[i] || ' ' || {w}[i + 1] for i in range(1, len({w}))])"
    words = lambda c: f"list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda w: lower(w))"
    return rf"""
WITH templates AS (SELECT license, {grams('w')} AS b FROM (SELECT t.n AS license, {words('t.t')} AS w FROM (VALUES {values}) t(n, t))),
docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n') AS blocks, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
parts AS (
  SELECT doc_id, 'text' AS unit, 0::BIGINT AS no, text AS part FROM docs
  UNION ALL SELECT doc_id, 'block', i - 1, blocks[i] FROM (SELECT doc_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM docs WHERE len(blocks) > 1)
  UNION ALL SELECT doc_id, 'line', i - 1, lines[i] FROM (SELECT doc_id, text, blocks, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs) WHERE lines[i] <> text AND NOT list_contains(blocks, lines[i])),
grams AS (SELECT doc_id, unit, no, {grams('w')} AS a FROM (SELECT doc_id, unit, no, {words('part')} AS w FROM parts)),
scored AS (SELECT doc_id, unit, no, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM grams, templates WHERE len(a) > 0 AND len(b) BETWEEN len(a) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(a) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)
SELECT doc_id, unit, no, license, dice FROM scored WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, no ORDER BY dice DESC, license) = 1"""
