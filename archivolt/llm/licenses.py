"""License scans: Dice coefficient over word bigrams against license templates.

Lines, paragraphs (runs of lines with words), whole texts, and every run of as
many words as a template has, wherever it starts, are the candidates.
A candidate and a template that reach the threshold t have sizes within a factor
of t / (2 - t), so a template is only compared with candidates of fitting size;
and at least half of t of both sizes must be shared, so candidates with too few
bigrams of any template are passed over at once.

The templates are a parameter of bounded size, broadcast; texts are scanned once
without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import ceil
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import small_batches
from archivolt.llm.decontaminate import words_of

THRESHOLD = 0.8
#: Words of all templates together; more are refused.
MOST_WORDS = 1_000_000
_FOUND = "array<struct<license:string,score:double,first_line:int,last_line:int>>"

# Notices by which public licenses are applied to a text, and their whole texts.
_CC = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
#: The condition and the disclaimers that follow the MIT notice, and those of the BSD licenses.
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
#: Whole texts, as published, by file name.
_TEXTS = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
_SPDX = (
    *("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"),
    *(f"CC-{short}-4.0" for short, _ in _CC),
)
TEMPLATES = (
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
    *((f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.") for short, _ in _CC),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for short, long in _CC if short not in ("BY", "BY-SA")),
    *_TEXTS,
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_2 + _BSD_REST),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_REST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _ISC),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT + _MIT_REST),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))  # noqa: B905  the shorter ends it


@dataclass
class Index:
    """Templates by size, and all their bigrams."""

    sizes: list[int]
    templates: list[tuple[str, set[tuple[bytes, bytes]]]]
    lengths: list[int]  # in words
    every: dict[tuple[bytes, bytes], list[int]]  # the places of the templates with a bigram
    words: set[bytes]
    threshold: float

    def fitting(self, size: int) -> list[tuple[str, set[tuple[bytes, bytes]]]]:
        """The templates whose sizes leave the threshold within reach."""
        share = self.threshold / (2 - self.threshold)
        low, high = size * share - 1e-9, size / share + 1e-9
        return self.templates[bisect_left(self.sizes, low) : bisect_right(self.sizes, high)]


def index(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Index:
    """Templates without a bigram (fewer than two words) match nothing."""
    words = [(name, words_of(text)) for name, text in templates]
    made = sorted(((name, bigrams(w), len(w)) for name, w in words if len(w) > 1), key=lambda x: (len(x[1]), x[0]))
    if sum(len(b) for _, b, _ in made) > MOST_WORDS:
        raise ValueError("too many templates for one broadcast")
    every: dict[tuple[bytes, bytes], list[int]] = {}
    for at, (_, b, _) in enumerate(made):
        for pair in b:
            every.setdefault(pair, []).append(at)
    return Index([len(b) for _, b, _ in made], [x[:2] for x in made], [n for _, _, n in made], every, {w for b in every for w in b}, threshold)


def _candidates(lines: list[list[bytes]]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, last line, words) of lines, paragraphs of several lines, and the whole."""
    yield from ((i, i, w) for i, w in enumerate(lines) if w)
    start = None
    blocks = []
    for i, words in enumerate([*lines, []]):
        if words and start is None:
            start = i
        elif not words and start is not None:
            blocks.append((start, i - 1))
            start = None
    whole = (blocks[0][0], blocks[-1][1]) if blocks else (0, 0)
    for first, last in dict.fromkeys([*blocks, whole]):
        if first < last:
            yield first, last, [w for x in lines[first : last + 1] for w in x]


def _windows(words: list[bytes], held: Index) -> Iterator[tuple[str, float, int, int]]:
    """(license, score, first word, last word) of the best run of words as long as a template, for each template.

    A run that reaches the threshold t shares t / (2 - t) of the template's
    bigrams at least, so only starts with so many of them ahead are looked at.
    """
    hits: dict[int, list[int]] = {}
    for i, pair in enumerate(zip(words, words[1:])):  # noqa: B905  the shorter ends it
        for at in held.every.get(pair, ()):
            hits.setdefault(at, []).append(i)
    for at, places in sorted(hits.items()):
        (name, template), span = held.templates[at], held.lengths[at] - 1  # bigrams of a run
        need = max(1, ceil(held.threshold / (2 - held.threshold) * len(template) - 1e-9))
        last_start = len(words) - 1 - span
        ranges: list[list[int]] = []
        for first, last in zip(places, places[need - 1 :]):  # noqa: B905
            low, high = max(0, last - span + 1), min(first, last_start)
            if low <= high:
                if ranges and low <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(high, ranges[-1][1])
                else:
                    ranges.append([low, high])
        best = (0.0, 0)
        for low, high in ranges:
            counts: dict[tuple[bytes, bytes], int] = {}
            shared = 0
            for i in range(low, high + span):
                pair = (words[i], words[i + 1])
                counts[pair] = counts.get(pair, 0) + 1
                shared += counts[pair] == 1 and pair in template
                if i >= low + span:
                    out = (words[i - span], words[i - span + 1])
                    counts[out] -= 1
                    if not counts[out]:
                        del counts[out]
                        shared -= out in template
                if i >= low + span - 1:
                    score = 2 * shared / (len(counts) + len(template))
                    if score > best[0]:
                        best = (score, i - span + 1)
        if best[0] >= held.threshold:
            yield name, best[0], best[1], best[1] + span


def scan(text: str | None, held: Index) -> list[tuple[str, float, int, int]]:
    """(license, score, first line, last line) of the best candidate of each license, by name."""
    best: dict[str, tuple[float, int, int]] = {}
    if not text or not held.sizes:
        return []
    largest = 2 * held.sizes[-1] / held.threshold  # bigrams beyond which no template fits
    lines = [words_of(x) for x in text.split("\n")]
    for first, last, words in _candidates(lines):
        if len(held.words.intersection(words)) < 2:
            continue
        found = bigrams(words)
        if not found or len(found) > largest:
            continue
        shared = found & held.every.keys()
        if 2 * len(shared) < held.threshold * len(found):
            continue
        for name, template in held.fitting(len(found)):
            score = 2 * len(shared & template) / (len(found) + len(template))
            if score >= held.threshold and (name not in best or score > best[name][0]):
                best[name] = (score, first, last)
    ends = list(accumulate(len(w) for w in lines))
    for name, score, first, last in _windows([w for line in lines for w in line], held):
        if name not in best or score > best[name][0]:
            best[name] = (score, bisect_right(ends, first), bisect_right(ends, last))
    return [(name, *x) for name, x in sorted(best.items())]


def find_licenses(docs: DataFrame, *, text: str = "text", into: str = "licenses", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``into``: (license, score, first_line, last_line) by license.

    Of equal scores the earliest line wins, then paragraphs, then the whole text,
    then the earliest run of words.
    Null and empty texts have none; lines count from 0.
    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index(templates, threshold))

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        for texts in batches:
            rows = [[dict(zip(("license", "score", "first_line", "last_line"), x, strict=True)) for x in scan(t, held)] for t in texts]
            yield pd.Series(rows, index=texts.index, dtype=object)

    return small_batches(docs).withColumn(into, F.pandas_udf(scanned, _FOUND).asNondeterministic()(F.col(f"`{text}`")))


def digest(found: DataFrame) -> DataFrame:
    """A row per document: how many licenses, their names, and the best score."""
    scores = F.transform("licenses", lambda x: x["score"])
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("best_score"),
    )


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same by DuckDB: all candidates but the runs of words against all templates."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in templates)
    fold = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"regexp_extract_all({fold.format(x)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
with t as (select name, {pairs} as b from (select name, {words('body')} as w from (values {values}) v(name, body))),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
numbered as (select doc_id, i, {words('line')} as w from lines),
blocks as (select *, sum(case when len(w) = 0 then 1 else 0 end) over (partition by doc_id order by i) as block from numbered),
units as (
  select doc_id, w from numbered
  union all select doc_id, flatten(list(w order by i)) from blocks where len(w) > 0 group by doc_id, block
  union all select doc_id, flatten(list(w order by i)) from numbered group by doc_id),
c as (select doc_id, {pairs} as b from units where len(w) > 1),
s as (
  select doc_id, name, max(2 * len(list_intersect(c.b, t.b)) / (len(c.b) + len(t.b))) as score from c join t
    on len(c.b) >= len(t.b) * {threshold} / (2 - {threshold}) - 1e-9 and len(t.b) >= len(c.b) * {threshold} / (2 - {threshold}) - 1e-9
  group by doc_id, name),
f as (select * from s where score >= {threshold})
select d.doc_id, count(f.name)::bigint as n_licenses, coalesce(string_agg(f.name, ',' order by f.name), '') as licenses, coalesce(max(f.score), 0.0)::double as best_score
from documents d left join f using (doc_id) group by d.doc_id
"""
