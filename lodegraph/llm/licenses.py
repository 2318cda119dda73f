"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is lower-cased, everything but letters and digits becomes a space, and a unit is the set of its adjacent word pairs (a
single word is a pair with nothing). Two sets of a and b pairs can reach a coefficient t only if b lies between a t / (2 - t)
and a (2 - t) / t, so templates are kept by size and a unit is compared only with those in its bounds. Units are single lines,
runs of neighbouring lines that each share a pair with some template (licences broken over lines), the whole text, and windows
of words: of all stretches of adjacent words, those that match a template best. A window that reaches t holds t / (2 - t) of the
template's pairs at least, so only templates with as many in the text are searched, and only from pair to pair of the template.
Of windows that overlap the best one counts, and none that overlaps a line, run or text that matches as well.

Every window of every whole text is looked at. The result has one row per document: the best match (greatest coefficient, then
larger template, then name) and how many units match; without a match the licence is null and the score 0. Null and empty texts
match nothing. Repeated rows and ids are judged each. A projection in Arrow batches: no shuffle, no state.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
_WORDS = re.compile(r"[^\W_]+")

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
    "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

#: (licence, text): texts and the notices that refer to them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL.format(3)), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", _GPL.format(2)), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause", _BSD), ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", _ISC), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE), ("all-rights-reserved", "All rights reserved."),
]

Pairs = frozenset[tuple[str, str]]


def pairs(words: list[str]) -> Pairs:
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w, "") for w in words)


def normalised(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def dice(a: Pairs, b: Pairs) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass(frozen=True)
class Match:
    score: float
    size: int
    licence: str
    first: int
    last: int


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> None:
        kept = sorted(((len(p), n, p) for n, t in (templates or TEMPLATES) if (p := pairs(normalised(t)))), key=lambda x: (x[0], x[1]))
        self.threshold, self.kept, self.sizes = threshold, kept, [k[0] for k in kept]
        self.least = min(self.sizes) * threshold / (2 - threshold)
        self.most = max(self.sizes) * (2 - threshold) / threshold
        self.known = frozenset().union(*(p for _, _, p in kept)) if kept else frozenset()
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, p) in enumerate(kept):
            for pair in p:
                self.holders.setdefault(pair, []).append(k)

    def best(self, unit: Pairs, first: int, last: int) -> Match | None:
        n = len(unit)
        lo = bisect_left(self.sizes, n * self.threshold / (2 - self.threshold) - 1e-9)
        hi = bisect_right(self.sizes, n * (2 - self.threshold) / self.threshold + 1e-9)
        found = None
        for size, name, p in self.kept[lo:hi]:
            s = dice(unit, p)
            if s >= self.threshold and (found is None or (-s, -size, name) < (-found.score, -found.size, found.licence)):
                found = Match(s, size, name, first, last)
        return found

    def matches(self, text: str | None) -> list[Match]:
        if not text:
            return []
        out, run, lines = [], [], 0
        everything: list[str] = []

        def flush() -> None:
            if len(run) > 1:
                unit = pairs([w for _, ws in run for w in ws])
                if self.least <= len(unit) <= self.most and (m := self.best(unit, run[0][0], run[-1][0])):
                    out.append(m)
            run.clear()

        for k, line in enumerate(text.split("\n")):
            lines += 1
            words = normalised(line)
            everything += words
            unit = pairs(words)
            if not unit:
                continue
            if unit.isdisjoint(self.known):
                flush()
                continue
            run.append((k, words))
            if self.least <= len(unit) <= self.most and (m := self.best(unit, k, k)):
                out.append(m)
        flush()
        if lines > 1 and (whole := pairs(everything)) and self.least <= len(whole) <= self.most and (m := self.best(whole, 0, lines - 1)):
            out.append(m)
        return out


    def _windows(self, seq: list[tuple[str, str]], k: int) -> Iterator[tuple[float, int, int]]:
        """(score, first pair, last pair): for each pair of template k, the best of the windows that begin with it. A window in
        which its first pair comes again has the same set without it, so it ends before; so does one that outgrows the bounds."""
        size, _, p = self.kept[k]
        t = self.threshold
        most = size * (2 - t) / t + 1e-9
        for i, head in enumerate(seq):
            if head not in p:
                continue
            seen, hits, top = set(), 0, (0.0, 0, 0)
            for j in range(i, len(seq)):
                pair = seq[j]
                if pair == head and j > i:
                    break
                if pair in seen:
                    continue
                seen.add(pair)
                if len(seen) > most:
                    break
                if pair in p:
                    hits += 1
                    top = max(top, (2 * hits / (len(seen) + size), i, j), key=lambda x: x[0])
            if top[0] >= t:
                yield top

    def windows(self, text: str | None) -> list[Match]:
        """The best windows of words, none overlapping another."""
        words, at = [], []
        for k, line in enumerate((text or "").split("\n")):
            new = normalised(line)
            words += new
            at += [k] * len(new)
        seq = list(zip(words, words[1:], strict=False))
        found = []
        for wide, chain in ((1, seq), (0, [(w, "") for w in words])):
            there = Counter(k for pair in set(chain) & self.known for k in self.holders[pair])
            for k, n in there.items():
                size, name, _ = self.kept[k]
                if n >= size * self.threshold / (2 - self.threshold) - 1e-9:
                    found += [(-s, -size, name, i, j + wide) for s, i, j in self._windows(chain, k)]
        out, taken = [], []
        for s, size, name, i, j in sorted(found):
            spot = bisect_left(taken, (i, -1))
            if (spot and taken[spot - 1][1] >= i) or (spot < len(taken) and taken[spot][0] <= j):
                continue
            taken.insert(spot, (i, j))
            out.append(Match(-s, -size, name, at[i], at[j]))
        return out

    def everything(self, text: str | None) -> list[Match]:
        """matches(), and the windows that say more than these."""
        units = self.matches(text)
        rank = lambda m: (-m.score, -m.size, m.licence)
        return units + [w for w in self.windows(text) if not any(u.first <= w.last and w.first <= u.last and rank(u) <= rank(w) for u in units)]


def scanned(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, score, first_line, last_line, n_matches, licenses) of every row; lines from 0; licenses: the distinct
    names, sorted and joined by commas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            out = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                found = scanner.everything(t)
                if found:
                    top = min(found, key=lambda m: (-m.score, -m.size, m.licence, m.first))
                    out.append((i, top.licence, top.score, top.first, top.last, len(found), ",".join(sorted(Counter(m.licence for m in found)))))
                else:
                    out.append((i, None, 0.0, None, None, 0, ""))
            d = pd.DataFrame(out, columns=["doc_id", "license", "score", "first_line", "last_line", "n_matches", "licenses"])
            yield d.astype({"doc_id": "Int64", "first_line": "Int64", "last_line": "Int64", "n_matches": "int64"})

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInPandas(run, "doc_id long, license string, score double, first_line long, last_line long, n_matches long, licenses string")


def op4_dice_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents for all templates."""
    return scanned(table(spark, sf_dir, "documents"))
