"""Operator 6: licence scans by the Dice coefficient over word bigrams.

A text's normalised words (lower case, letters and digits) are compared to licence
templates: whole licence texts, their usual headers and one-line notices. For a
template of m words every window of m words of the text (the whole text, if it has
fewer) is a unit, so a licence is found alone, inside prose, under a copyright line
and however its lines are wrapped. A window's bigrams are a set, and
2 |A & B| / (|A| + |B|) compares it to the template's set.

Size bounds prune templates: a Dice coefficient of t needs at least
t / (2 - t) |B| shared bigrams, and no window has more of them than the whole text.
Shared bigrams of a text are counted over an index from bigram to templates, and
windows are moved over the text only for templates that have enough.

Consecutive windows over the threshold are one match, of which the best (then the
first) window stands. Texts are read inside a task, one at a time; nothing is
shuffled.

Defined results
    null or empty text, or one of less than two words: no match; very long texts
    are read whole; null or repeated ``doc_id`` and repeated rows: a row each; ties
    of a document's best match go to the larger template, then the earlier one,
    then the earlier place; other columns, whatever their names, are not read;
    empty table: no rows.

Licences without a whole text here (AGPL, CC BY) are found by their notices only.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from importlib.resources import files
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.llm.text import body
from eigenloom.session import text_batches

THRESHOLD = 0.8
#: Whole licence texts, by the name of their file in ``license_texts``.
WHOLE = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0")
#: Usual licence notices by SPDX-like id.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
_TOKEN = re.compile(r"[^\W_]+")


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every template. Read on the driver, where the package's files are."""
    texts = files("eigenloom.llm") / "license_texts"
    return tuple((name, (texts / f"{name}.txt").read_text(encoding="utf-8")) for name in WHOLE) + NOTICES


def words(text: str) -> list[str]:
    """The normalised words of a text."""
    return _TOKEN.findall(text.lower())


class Scanner:
    """Templates indexed by bigram."""

    def __init__(self, known: tuple[tuple[str, str], ...], threshold: float = THRESHOLD):
        self.names = [name for name, _ in known]
        found = [words(text) for _, text in known]
        self.lengths = [len(w) for w in found]
        self.sets = [set(zip(w, w[1:], strict=False)) for w in found]
        self.threshold = threshold
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, pairs in enumerate(self.sets):
            for pair in pairs:
                self.index.setdefault(pair, []).append(k)
        self.least = [threshold / (2 - threshold) * len(s) for s in self.sets]

    def candidates(self, pairs: list[tuple[str, str]]) -> list[int]:
        """Templates of which a text has enough bigrams, whatever the window."""
        shared = Counter(k for pair in self.index.keys() & set(pairs) for k in self.index[pair])
        return sorted(k for k, n in shared.items() if n >= self.least[k] - 1e-9)

    def windows(self, pairs: list[tuple[str, str]], k: int) -> Iterator[tuple[int, float]]:
        """(first word, dice) of every window over the threshold."""
        width, own = min(self.lengths[k] - 1, len(pairs)), self.sets[k]
        seen: dict[tuple[str, str], int] = {}
        shared = 0
        for at, pair in enumerate(pairs):
            if at >= width:
                left = pairs[at - width]
                seen[left] -= 1
                if not seen[left]:
                    del seen[left]
                    shared -= left in own
            seen[pair] = seen.get(pair, 0) + 1
            shared += seen[pair] == 1 and pair in own
            if at >= width - 1:
                dice = 2 * shared / (len(seen) + len(own))
                if dice >= self.threshold:
                    yield at - width + 1, dice

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(start, end, licence, dice, words of the template) of every match, the best first."""
        text = text or ""
        found = words(text)
        pairs = list(zip(found, found[1:], strict=False))
        matches = []
        for k in self.candidates(pairs):
            last, best = None, None
            for at, dice in self.windows(pairs, k):
                if last is None or at > last + 1:
                    matches.append(best := [-dice, -self.lengths[k], k, at])
                elif -dice < best[0]:
                    best[0], best[3] = -dice, at
                last = at
        if not matches:
            return []
        places = [m.span() for m in _TOKEN.finditer(text.lower())]
        if len(text.lower()) != len(text):  # a letter whose lower case is longer: offsets of the text itself
            places = _places(text)
        out = []
        for less, size, k, at in sorted(matches):
            end = min(at - size, len(found)) - 1
            out.append((places[at][0], places[end][1], self.names[k], -less, -size))
        return out


def _places(text: str) -> list[tuple[int, int]]:
    """Character offsets of the words in a text of which some letters grow when lower-cased."""
    origin = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
    lower = "".join(c.lower() for c in text)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _TOKEN.finditer(lower)]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known=None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_matches, matches) of every document.

    ``license`` and ``dice`` are the best match's; ``matches`` is an array of
    (start, end, license, dice, template_words) with character offsets, the best first.
    ``known``: (licence, text) of the templates, else those of this module.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(known) if known is not None else templates())
    fields = ("start", "end", "license", "dice", "template_words")

    @F.pandas_udf("array<struct<start: long, end: long, license: string, dice: double, template_words: long>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value, threshold)
        for batch in texts:
            yield pd.Series([[dict(zip(fields, m, strict=True)) for m in scanner.scan(t)] for t in batch])

    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), scan(body(text_col)).alias("matches"))
    best = F.get("matches", F.lit(0))
    return found.select("doc_id", best["license"].alias("license"), best["dice"].alias("dice"), F.size("matches").cast("long").alias("n_matches"), "matches")
