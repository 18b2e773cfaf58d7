"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down directories.

Passages are every line with a word, the whole text, and for each template every window of as
many words as it has, across lines. Passages and templates are vectors of word counts times
inverse document frequency; the frequencies of the template words are counted over all texts,
and a word outside the templates weighs like a word in no text. Lines are compared with the
short notices from ``MIN_COSINE`` on; whole texts and windows with licence texts, headers and
notices from ``MIN_WIDE`` on, and with titles and SPDX tags where all words are equal. A match
of a licence's text goes before one of a header, that before notices, titles and lines, and
"All rights reserved" within a line comes last; then the best cosine decides.
Texts whose file name names a licence file declare their licence for their directory; a text
without its own takes the one of its nearest ancestor directory that has one, found by joining
directories, not files.

Defined results: a null, empty or wordless text has no passage and no own licence. Equal
cosines go to the earlier line, then to the first template by name. If several licence files
of a directory differ, the highest cosine decides, then the smaller path. A null path, and a
path outside any directory, is a file of the root directory "". Repeated rows are carried; no
licence is null with a cosine of 0. Extra columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import settled
from voxtable.scale import Lookup

MIN_COSINE = 0.6
# Windows are taken at every place, so chance has many tries; copies with other names stay above.
MIN_WIDE = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)[^/]*$"

# Short notices that licence files and headers carry.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

# Kinds of wide templates, the most telling first.
TEXT, HEADER, NOTICE, TAG, RIGHTS = range(5)
_FREE = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, {2}."
_WITHOUT = (
    " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
    " FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
)
_LATER, _ONLY = "either version {0} of the License, or (at your option) any later version", "version {0} of the License"
HEADERS = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy"
        " of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the"
        " License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific"
        " language governing permissions and limitations under the License."
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can"
        " obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    **{
        f"{short}-{v}": [_FREE.format(it, of, terms.format(v.removesuffix(".0"))) + more for terms in (_LATER, _ONLY) for more in ("", _WITHOUT.format(it, of))]
        for short, it, of, versions in (
            ("GPL", "This program", "", ("2.0", "3.0")), ("LGPL", "This library", "Lesser ", ("2.1", "3.0")), ("AGPL", "This program", "Affero ", ("3.0",)),
        )
        for v in versions
    },
}
NOTICES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
}
TAGS = {
    "Apache-2.0": ["Apache License 2.0", "Apache License Version 2.0"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License"], "ISC": ["ISC License"], "MIT": ["MIT License", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"], "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3"], "GPL-2.0": ["GNU General Public License Version 2"], "GPL-3.0": ["GNU General Public License Version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License Version 3"],
}
_GNU = ("AGPL-3.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")


def wide_templates() -> dict[tuple[int, str, int], str]:
    """Texts by kind, licence and number: licence texts, headers, notices, titles and SPDX tags."""
    texts = {p.name.removesuffix(".txt"): [p.read_text()] for p in (Path(__file__).parent / "licence_texts").glob("*.txt")}
    tags = {n: list(t) for n, t in TAGS.items()}
    for n in {*texts, *HEADERS, *NOTICES, *TEMPLATES} - {"Proprietary"}:
        tags.setdefault(n, []).extend(f"SPDX-License-Identifier: {n}{end}" for end in (("-or-later", "-only", "") if n in _GNU else ("",)))
    notices = {n: [*([TEMPLATES[n]] if n in TEMPLATES and n != "Proprietary" and n != "MIT" else []), *NOTICES.get(n, [])] for n in {*TEMPLATES, *NOTICES}}
    return {(kind, n, i): t for kind, made in ((TEXT, texts), (HEADER, HEADERS), (NOTICE, notices), (TAG, tags), (RIGHTS, {"Proprietary": [TEMPLATES["Proprietary"]]})) for n, of in made.items() for i, t in enumerate(of)}


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows = cx.spans(cx.NOT_ALNUM[data], offsets)
    return cx.hasher(41)(data, starts, ends), starts, rows


def _hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _word_hashes(data, np.array([0, len(data)]))[0]


class Templates:
    """Template vectors over the sorted hashes of their words."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        words = {n: _hashes_of(texts[n]) for n in self.names}
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *words.values()]))
        self.counts = np.zeros((len(self.names), len(self.words)))
        for i, n in enumerate(self.names):
            np.add.at(self.counts[i], np.searchsorted(self.words, words[n]), 1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, or the number of words for one of no template."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))


def document_frequencies(docs: DataFrame, templates: Templates, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Texts that hold each template word, and all texts with a word."""
    width = len(templates.words)

    def count(batches):
        found, total = np.zeros(width, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in cx.groups(batch.column(0)):
                hashes, _, rows = _word_hashes(data, offsets)
                at = templates.place(hashes)
                known = at < width
                pairs = np.unique(rows[known] * width + at[known])
                found += np.bincount(pairs % width, minlength=width)
                total += len(np.unique(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(width), -1]), pa.array(np.r_[found, total])], ["w", "n"])

    sums = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    got = {r["w"]: r["n"] for r in sums.collect()}  # one row per template word
    return np.array([got.get(i, 0) for i in range(width)], float), got.get(-1, 0)


class Wide:
    """Wide templates as unit vectors, with the least cosine each needs."""

    def __init__(self, keys: list, counts: np.ndarray, idf: np.ndarray):
        self.keys, self.idf = keys, idf
        weights = counts * idf[:-1]
        self.weights = np.c_[weights / np.sqrt((weights**2).sum(1, keepdims=True)), np.zeros(len(keys))]
        self.squares = self.weights**2
        self.sizes = counts.sum(1).astype(int)
        self.least = np.array([1 - 1e-6 if kind >= TAG else MIN_WIDE for kind, _, _ in keys])

    def matches(self, at: np.ndarray, hashes: np.ndarray, rows: np.ndarray, n: int):
        """(row, template, cosine, first word) of the best passage of every pair that reaches its bound."""
        # A passage has at most the weight of all template words that its text holds.
        order = np.lexsort((hashes, rows))
        r, h, w = rows[order], hashes[order], at[order]
        fresh = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, int)
        counts = np.diff(np.r_[fresh, len(r)])
        r, w = r[fresh], w[fresh]
        norm = np.sqrt(np.bincount(r, (counts * self.idf[w]) ** 2, n))
        inner = np.flatnonzero(w < len(self.idf) - 1)
        r, w, value = r[inner], w[inner], counts[inner] * self.idf[w[inner]]
        total = np.bincount(rows, minlength=n)
        first = np.searchsorted(rows, np.arange(n))
        for t, (size, least) in enumerate(zip(self.sizes.tolist(), self.least.tolist())):
            able = np.bincount(r, self.squares[t, w], n) >= least * least - 1e-9
            if not able.any():
                continue
            dots = np.bincount(r, value * self.weights[t, w], n)
            for i in np.flatnonzero(able & (dots >= (least - 1e-12) * norm)).tolist():
                yield i, t, round(dots[i] / norm[i], 6), first[i]
            at_words = np.flatnonzero((able & (total >= size))[rows])
            if len(at_words) >= size:
                yield from self._windows(t, size, least, at[at_words], hashes[at_words], rows[at_words], at_words)

    def _windows(self, t: int, size: int, least: float, at, hashes, rows, places):
        weight = self.idf[at]
        dots = _sums(weight * self.weights[t, at], size)
        # The square of a count is no less than the count, so this is no more than the norm.
        low = _sums(weight**2, size)
        hit = np.flatnonzero((dots >= (least - 1e-9) * np.sqrt(low)) & (rows[: len(dots)] == rows[size - 1 :]))
        if not len(hit):
            return
        held = np.flatnonzero(np.isin(rows, rows[hit]))
        moved = np.zeros(len(rows), int)
        moved[held] = np.arange(len(held))
        squares = _window_squares(hashes[held], self.idf[at[held]], size)
        cosine = dots[hit] / np.sqrt(squares[moved[hit]])
        good = cosine >= least - 1e-12
        hit, cosine = hit[good], np.round(cosine[good], 6)
        order = np.lexsort((hit, -cosine, rows[hit]))
        hit, cosine = hit[order], cosine[order]
        for k in np.flatnonzero(np.r_[True, rows[hit][1:] != rows[hit][:-1]][: len(hit)]).tolist():
            yield int(rows[hit[k]]), t, cosine[k], places[hit[k]]


def _sums(values: np.ndarray, size: int) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[size:] - total[:-size]


def _window_squares(hashes: np.ndarray, idf: np.ndarray, size: int) -> np.ndarray:
    """Sum over the distinct words of each window of (count * idf) squared."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    word = np.zeros(n, np.int64)
    word[order] = np.cumsum(np.r_[0, hashes[order][1:] != hashes[order][:-1]])
    keys = word[order] * (n + 1) + order
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at = np.arange(n)
    before = rank - np.searchsorted(keys, word * (n + 1) + np.maximum(at - size + 1, 0))  # equal words in the size - 1 places before
    after = np.searchsorted(keys, word * (n + 1) + np.minimum(at + size - 1, n - 1), "right") - rank - 1
    # A word that comes in as the c-th of its kind adds 2c - 1 squares; going out as the c-th, it takes as many.
    added, taken = idf**2 * (2 * before + 1), idf**2 * (2 * after + 1)
    return np.cumsum(np.r_[added[:size].sum(), added[size:] - taken[: n - size]])


def own_licences(
    docs: DataFrame, keep: list[str], text_col: str = "text", templates: dict[str, str] | None = None, min_cosine: float = MIN_COSINE,
    wide: dict[tuple[int, str, int], str] | None = None,
) -> DataFrame:
    """Columns ``keep`` with the text's own licence, its cosine and its line (from 1; 0 for none).

    ``templates`` are compared with lines, ``wide`` ones with windows and whole texts; where
    only ``templates`` are given there are no wide ones.
    """
    wide = (wide_templates() if templates is None else {}) if wide is None else wide
    templates = TEMPLATES if templates is None else templates
    known = Templates({**{(-1, n, 0): t for n, t in templates.items()}, **wide})
    frequency, total = document_frequencies(docs, known, text_col)
    idf = np.log((1 + total) / (1 + np.append(frequency, 0.0))) + 1
    lines_of = np.array([kind < 0 for kind, _, _ in known.names], bool)
    broad = Wide([k for k in known.names if k[0] >= 0], known.counts[~lines_of], idf) if wide else None
    # In lines, only words of the line templates weigh by their frequency.
    short = np.append(known.counts[lines_of].sum(0) > 0, False)
    line_idf = np.where(short, idf, idf[-1])
    names = [n for kind, n, _ in known.names if kind < 0]
    weights = known.counts[lines_of] * line_idf[:-1]
    weights = weights / np.sqrt((weights**2).sum(1, keepdims=True))

    def run(data, offsets):
        hashes, starts, rows = _word_hashes(data, offsets)
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        at = known.place(hashes)
        found: list = [None] * n  # (kind, -cosine, line, licence), the least one

        def note(r: int, kind: int, name: str, cosine: float, start: int):
            line_no = int(np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets[r])) + 1
            # Notices, titles and lines count alike; reserved rights within a line only where there is nothing else.
            new = (NOTICE if kind == TAG else kind, -float(np.round(cosine, 12)), line_no, name)
            if found[r] is None or new < found[r]:
                found[r] = new

        if broad is not None:
            for r, t, cosine, place in broad.matches(at, hashes, rows, n):
                note(r, broad.keys[t][0], broad.keys[t][1], cosine, starts[place])
        line = np.searchsorted(breaks, starts) + rows  # lines of neighbouring texts differ
        # Only lines with a word of a line template can match one.
        lines = np.unique(line[short[at]])
        used = np.isin(line, lines, assume_unique=False)
        line, at, hashes, starts, rows = (x[used] for x in (line, at, hashes, starts, rows))
        if len(line):
            slot = np.searchsorted(lines, line)
            order = np.lexsort((hashes, slot))
            slot, at, hashes = slot[order], at[order], hashes[order]
            fresh = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (hashes[1:] != hashes[:-1])])
            counts = np.diff(np.r_[fresh, len(slot)])
            slot, at = slot[fresh], at[fresh]
            value = counts * line_idf[at]
            norm = np.sqrt(np.bincount(slot, value**2, len(lines)))
            inner = short[at]
            dots = np.zeros((len(lines), len(names)))
            np.add.at(dots, slot[inner], value[inner, None] * weights[:, at[inner]].T)
            dots /= norm[:, None]
            best = np.round(dots, 12).argmax(1)
            score = np.round(dots[np.arange(len(lines)), best], 12)
            first_word = np.searchsorted(line, lines)
            for k in np.flatnonzero(score >= min_cosine).tolist():
                note(int(rows[first_word[k]]), NOTICE, names[best[k]], score[k], starts[first_word[k]])
        return [
            pa.array([f and f[3] for f in found], pa.string()), pa.array([-f[1] if f else 0.0 for f in found], pa.float64()),
            pa.array([f[2] if f else 0 for f in found], pa.int64()),
        ]

    return cx.text_map(docs, text_col, run, "own_licence string, cosine double, line long", keep)


def directory(path: Column) -> Column:
    """The path up to its last slash; "" for none."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def inherit(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``licence`` and ``from_dir`` to rows of ``own_licences`` that carry a path."""
    placed = files.withColumn("__dir", directory(F.col(path_col)))
    declared = placed.filter(F.col("own_licence").isNotNull() & F.col(path_col).rlike(LICENCE_FILE))
    declared = declared.groupBy("__dir").agg(F.min_by("own_licence", F.struct(-F.col("cosine"), F.col(path_col))).alias("found"))
    # Distinct directories, each with all its ancestors: far fewer rows than files.
    dirs = placed.select("__dir").distinct()
    parts = F.split("__dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))
    climbed = dirs.select("__dir", F.inline(F.array_distinct(chain)))
    nearest = climbed.join(declared.select(F.col("__dir").alias("up"), "found"), "up").groupBy("__dir").agg(F.max_by(F.struct("found", "up"), F.struct("depth", "up")).alias("near"))
    # Paths may have any length, so the table's bytes decide whether it is broadcast.
    nearest = Lookup.settle(nearest.select("__dir", F.col("near.found").alias("__found"), F.col("near.up").alias("__up")))
    return nearest.join(placed, "__dir").select(
        *files.columns, F.coalesce("own_licence", "__found").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("__up")).alias("from_dir"),
    )


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: own licence, cosine, line, the licence in force and where it comes from."""
    files = docs.select(F.col(f"`{id_col}`").alias("doc_id"), path.cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # The texts are read once; directories and their licences come from this small table.
    return inherit(settled(own_licences(files, ["doc_id", "path"])))
