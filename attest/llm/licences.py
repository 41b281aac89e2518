"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text and templates are lower-cased; all but letters and digits is white space, line breaks too. Dice is
twice the bigrams in common (as multisets) over those of both; at a threshold t it can only be reached if
the smaller count is at least t / (2 - t) of the larger, and then at least that share of the template's
bigrams is in common. So a template is looked for only where that many words that begin one of its bigrams
lie within its upper bound of one another; elsewhere it is pruned.

Units are runs of words inside a text, wherever its lines and paragraphs break: around such a place, the run
of the best ratio is found for bigrams that count each time they occur (each step takes the run of the
largest excess over the last ratio, until that no longer grows), and measured as multisets; if that fails
because bigrams repeat, again with their first times alone. Runs that
reach the threshold are matches; of runs that overlap the best stays.

Defined results: null or empty text, or one without a match: no licence (null, 0). Ties go to the larger
run, then to the name first by code point. A text of one word has no bigram and matches nothing. Texts of
any length are scanned whole. Repeated rows give repeated rows; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

import pkgutil
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import steps
from ._text import _BASE, mixed, words

THRESHOLD = 0.8

#: Notices and short texts of public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

#: Whole texts of licences, in files beside this one, by their names there.
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic-1.0": "Artistic", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


def templates() -> dict[str, str]:
    return TEMPLATES | {name: pkgutil.get_data(__package__, f"licence_texts/{file}.txt").decode("utf-8") for name, file in WHOLE.items()}


_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Words of letters and digits, one space between."""
    return _OTHER.sub(" ", text.lower())


def bigrams(text: str) -> Counter:
    w = normalised(text).split()
    return Counter(zip(w, w[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


class Matcher:
    """Templates, and the words and bigrams of texts as numbers."""

    def __init__(self, of: dict[str, str], threshold: float):
        self.threshold = threshold
        self.names = sorted(of)
        numbers = [words([normalised(of[name])])[0] for name in self.names]
        pairs = [self._pair(x[:-1], x[1:]) for x in numbers]
        self.known = np.unique(np.concatenate([np.zeros(0, "uint64"), *pairs]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True
        self.counts = []
        self.member = np.zeros((len(self.names), len(self.known)), bool)
        for k, x in enumerate(pairs):
            own, times = np.unique(x, return_counts=True)
            self.member[k, np.searchsorted(self.known, own)] = True
            self.counts.append(dict(zip(np.searchsorted(self.known, own).tolist(), times.tolist(), strict=True)))
        self.sizes = np.array([len(x) for x in pairs])
        share = threshold / (2 - threshold)
        self.need, self.most = np.ceil(share * self.sizes - 1e-9).astype(int), np.floor(self.sizes / share + 1e-9).astype(int)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(a * _BASE + b)

    def _first_times(self, k: int, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Places but those whose bigram came before as often as the template has it, not further back than a run may reach."""
        seen: dict[int, list[int]] = {}
        keep = []
        for i, (x, w) in enumerate(zip(at.tolist(), which.tolist(), strict=True)):
            earlier, most = seen.setdefault(w, []), self.counts[k][w]
            if len(earlier) < most or x - earlier[-most] > self.most[k]:
                earlier.append(x)
                keep.append(i)
        return np.array(keep)

    def _run(self, k: int, at: np.ndarray, which: np.ndarray) -> tuple[float, int, int] | None:
        """The best run among places of bigrams of template k (at, in order; which: their numbers): dice, first and last place.

        Where a run repeats bigrams more often than the template has them, their first times count alone.
        """
        n = int(self.sizes[k])
        for counted in (lambda: at, lambda: at[self._first_times(k, at, which)]):
            own, ratio, a, z = counted(), 0.0, 0, 0
            while True:
                # Excess of a run over the ratio: 2 for each place, less the ratio for each bigram of it.
                ends = 2.0 * np.arange(1, len(own) + 1) - ratio * (own + 1)
                starts = 2.0 * np.arange(len(own)) - ratio * own
                end = int(np.argmax(ends - np.minimum.accumulate(starts)))
                start = int(np.argmin(starts[: end + 1]))
                better = 2 * (end - start + 1) / (own[end] - own[start] + 1 + n)
                if better <= ratio + 1e-12:
                    break
                ratio, a, z = better, int(own[start]), int(own[end])
            inside = which[np.searchsorted(at, a) : np.searchsorted(at, z, "right")]
            both = sum(min(c, self.counts[k][w]) for w, c in Counter(inside.tolist()).items())
            dice = 2 * both / (z - a + 1 + n)
            if dice >= self.threshold - 1e-12:
                return dice, a, z
        return None

    def scan(self, texts: list[str]) -> list[list[tuple[float, int, str]]]:
        """Of each text, its matches: (dice, bigrams of the run, template)."""
        number, first, _, _ = words([normalised(x) for x in texts])
        out: list[list[tuple[float, int, str]]] = [[] for _ in texts]
        if len(number) < 2 or not len(self.known):
            return out
        pair = self._pair(number[:-1], number[1:])
        at = np.flatnonzero(self.maybe[pair & np.uint64((1 << 20) - 1)])
        which = np.minimum(np.searchsorted(self.known, pair[at]), len(self.known) - 1)
        true = self.known[which] == pair[at]
        # A bigram goes from one word to the next of the same text.
        doc = np.searchsorted(first, at, "right") - 1
        true &= at + 1 < first[doc + 1]
        at, which, doc = at[true], which[true], doc[true]
        found: dict[int, list[tuple[float, int, int, str]]] = {}
        for k, name in enumerate(self.names):
            own = np.flatnonzero(self.member[k, which])
            need, most = int(self.need[k]), int(self.most[k])
            if len(own) < need or not need:
                continue
            place, text = at[own], doc[own]
            near = np.flatnonzero((place[need - 1 :] - place[: len(place) - need + 1] < most) & (text[need - 1 :] == text[: len(place) - need + 1]))
            if not len(near):
                continue
            # Dense places that touch form one stretch.
            cut = np.flatnonzero((near[1:] > near[:-1] + need - 1) | (text[near[1:]] != text[near[:-1]])) + 1
            for group in np.split(near, cut):
                a, z = int(group[0]), int(group[-1]) + need
                todo = [(a, z)]
                while todo:
                    a, z = todo.pop()
                    if z - a >= need and (best := self._run(k, place[a:z], which[own[a:z]])):
                        found.setdefault(int(text[a]), []).append((best[0], best[1], best[2], name))
                        todo += [(a, a + int(np.searchsorted(place[a:z], best[1]))), (a + int(np.searchsorted(place[a:z], best[2], "right")), z)]
        for d, runs in found.items():
            taken: list[tuple[int, int]] = []
            for dice, x, y, name in sorted(runs, key=lambda r: (-r[0], r[1] - r[2], r[3], r[1])):
                if all(y < a or x > b for a, b in taken):
                    taken.append((x, y))
                    out[d].append((dice, y - x + 1, name))
        return out


def scanned(docs: DataFrame, of: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with doc_id and text -> doc_id, licence, dice, n_units, licences (all names, in order)."""
    of = templates() if of is None else of

    def scan(batches):
        matcher = Matcher(of, threshold)
        for batch in batches:
            for rows in steps(batch, "text"):
                licence, best, n, names = [], [], [], []
                for found in matcher.scan(rows["text"].fillna("").tolist()):
                    top = min(found, key=lambda x: (-x[0], -x[1], x[2]), default=(0.0, 0, None))
                    licence.append(top[2])
                    best.append(top[0])
                    n.append(len(found))
                    names.append(sorted({x[2] for x in found}))
                yield pd.DataFrame({"id": rows["id"], "no_id": rows["no_id"], "licence": licence, "dice": best, "n_units": n, "licences": names})

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = rows.mapInPandas(scan, "id long, no_id boolean, licence string, dice double, n_units long, licences array<string>")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "licence", "dice", "n_units", "licences")
