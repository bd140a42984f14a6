"""Licence notices in texts, found by patience alignment with templates.

Words (A-Z lower-cased) are compared by hash. For each template, words of which every
sufficient match must hold at least one are looked up in all texts at once; each
place opens a region of the template's length and some slack. In a region the
template is aligned: words unique in both sides are anchors, the longest increasing
run of anchors is kept, and the gaps between them are aligned in the same way, down
to equal beginnings and ends. The share of the template's words that are aligned is
its coverage. A match needs ``least`` coverage and all the template's telling words.

Defined cases: null, empty and wordless texts have no matches; repeated notices are
separate matches; where matches of several templates overlap, the one with more
aligned words stays (ties: greater coverage, then name, then place); very long texts
are handled whole, one at a time, and take time in proportion to their words and
matches; repeated rows give repeated rows; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .decontamination import WORD_BREAKS
from .shingles import hashed_words


@dataclass(frozen=True)
class Template:
    """A notice: licence, wording, and the words a match must contain."""

    licence: str
    text: str
    telling: str


#: Public wordings of licence notices. Fixed values.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "apache compliance",
    ),
    Template(
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu affero foundation 3",
    ),
    Template("all-rights-reserved", "All rights reserved.", "all rights reserved"),
    Template(
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "redistribution binary disclaimed",
    ),
    Template("bsd-3-clause", "Released under the BSD 3-Clause License.", "bsd 3"),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "redistribution binary endorse disclaimed",
    ),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "redistribution binary",
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu public 3"),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu foundation 3",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "permission fee granted disclaims",
    ),
    Template(
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "gnu lesser foundation 2 1",
    ),
    Template(
        "lgpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu lesser foundation 3",
    ),
    Template("mit", "Released under the MIT License.", "mit"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "permission granted sublicense noninfringement",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "permission granted sublicense",
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
)

#: Identifiers of the public licence list that are looked for behind its tag. Fixed values.
TAGGED = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0",
    "Unlicense", "WTFPL", "Zlib",
)
TEMPLATES += tuple(Template(tag.lower(), f"SPDX-License-Identifier: {tag}", f"spdx identifier {tag.replace('-', ' ').replace('.', ' ').lower()}") for tag in TAGGED)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose second also increases (by patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, second) in enumerate(pairs):
        pile = bisect_left(tops, second)
        before[k] = at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [second]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _places(words: list[int], low: int, high: int) -> dict[int, int]:
    """Place of each word that stands once in the range."""
    found: dict[int, int] = {}
    for k in range(low, high):
        found[words[k]] = -1 if words[k] in found else k
    return {w: k for w, k in found.items() if k >= 0}


def patience_alignment(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, both increasing."""
    aligned: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            aligned.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            aligned.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_b = _places(b, b0, b1)
        anchors = _increasing(sorted((k, in_b[w]) for w, k in _places(a, a0, a1).items() if w in in_b))
        if not anchors:
            continue
        aligned.extend(anchors)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps.extend((x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:]))
    return sorted(aligned)


class Scanner:
    """Templates compiled to word hashes and the words by which matches are looked up."""

    def __init__(self, templates: tuple[Template, ...], least: float, slack: float):
        self.templates, self.least, self.slack = templates, least, slack
        words, bounds = hashed_words([t.text for t in templates], WORD_BREAKS)
        telling, ends = hashed_words([t.telling for t in templates], WORD_BREAKS)
        self.words = [words[i:j].tolist() for i, j in zip(bounds, bounds[1:])]
        self.telling = [set(telling[i:j].tolist()) for i, j in zip(ends, ends[1:])]
        # A match holds every telling word, so the rarest of them is enough to find it; the longest stands for the rarest.
        self.keys = np.array([hashed_words([max(t.telling.split(), key=lambda w: (not w.isdigit(), len(w)))], WORD_BREAKS)[0][0] for t in templates], np.uint64)

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        words, bounds = hashed_words(texts, WORD_BREAKS)
        out: list[list[dict]] = [[] for _ in texts]
        distinct = np.unique(self.keys)
        at = np.minimum(np.searchsorted(distinct, words), len(distinct) - 1)
        hits = np.flatnonzero(distinct[at] == words)
        text = np.searchsorted(bounds, hits, "right") - 1
        for place, owner in zip(hits.tolist(), text.tolist()):
            low, high = int(bounds[owner]), int(bounds[owner + 1])
            for k in np.flatnonzero(self.keys == words[place]).tolist():
                found = self._align(k, words, place, low, high)
                if found:
                    out[owner].append(found)
        return [_apart(m) if len(m) > 1 else m for m in out]

    def _align(self, k: int, words: np.ndarray, place: int, low: int, high: int) -> dict | None:
        template = self.words[k]
        n = len(template)
        offset = template.index(int(self.keys[k]))
        spare = math.ceil(self.slack * n) + 1
        begin, end = max(low, place - offset - spare), min(high, place - offset + n + spare)
        region = words[begin:end].tolist()
        # The key at this place is an anchor; the sides are aligned apart, so a repeated notice nearby doesn't hide it.
        at = place - begin
        sides = patience_alignment(region[:at], template[:offset])
        sides.append((at, offset))
        sides.extend((at + 1 + x, offset + 1 + y) for x, y in patience_alignment(region[at + 1 :], template[offset + 1 :]))
        coverage = len(sides) / n
        if coverage < self.least or not self.telling[k] <= {region[x] for x, _ in sides}:
            return None
        first, last = sides[0][0], sides[-1][0]
        return {"licence": self.templates[k].licence, "first_word": begin + first - low, "n_words": last - first + 1, "aligned": len(sides), "coverage": coverage}


def _apart(found: list[dict]) -> list[dict]:
    """Matches that don't overlap, the fullest first; those kept stand in order of place, so only neighbours are compared."""
    firsts: list[int] = []
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: (-m["aligned"], -m["coverage"], m["licence"], m["first_word"])):
        first, end = m["first_word"], m["first_word"] + m["n_words"]
        at = bisect_left(firsts, first)
        if at and kept[at - 1]["first_word"] + kept[at - 1]["n_words"] > first or at < len(kept) and firsts[at] < end:
            continue
        firsts.insert(at, first)
        kept.insert(at, m)
    return kept


_MATCH = pa.list_(pa.struct([("licence", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("aligned", pa.int64()), ("coverage", pa.float64())]))


def _scanning(templates: tuple[Template, ...], least: float, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, slack)
        for batch in pieces(batches, 1, 2 << 20):
            found = scanner.matches(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _MATCH)], names=["id", "matches"])

    return run


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    least: float = 0.8,
    slack: float = 0.25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, matches`` for each row: licence, first word, words spanned, words aligned, coverage; one narrow pass."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, matches array<struct<licence: string, first_word: long, n_words: long, aligned: long, coverage: double>>"
    found = docs.select(id_col, text_col).mapInArrow(_scanning(templates, least, slack), schema)
    return found.select(F.col("id").alias(id_col), "matches")
