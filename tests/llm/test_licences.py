import math
import re
from collections import Counter

from pyspark.sql import functions as F

from helpers import empty_docs, odd_docs
from voxtable.llm import licences as q

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = {"MIT": "Released under the MIT License", "GPL": "licensed under the GNU General Public License version 3", "All": "All rights reserved"}


def words(text):
    return WORD.findall(text.lower())


def brute(docs):
    vocabulary = {w for t in SMALL.values() for w in words(t)}
    texts = [set(words(t or "")) for _, _, t in docs]
    total = sum(bool(t) for t in texts)
    idf = lambda w: math.log((1 + total) / (1 + (sum(w in t for t in texts) if w in vocabulary else 0))) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for i, path, text in docs:
        best = (None, 0.0, 0)
        for k, line in enumerate((text or "").split("\n")):
            v = vector(line)
            for name in sorted(SMALL):
                t = vector(SMALL[name])
                c = round(sum(v[w] * t[w] for w in v if w in t) / (norm(v) * norm(t)), 9) if v else 0
                if c >= q.MIN_COSINE and c > best[1]:
                    best = (name, c, k + 1)
        own[i] = (path or "", *best)
    out = {}
    for i, (path, name, cosine, line) in own.items():
        licence, origin = name, None
        parts = path.split("/")[:-1]
        while name is None:
            files = [(-c, p, n) for p, n, c, _ in own.values() if n and p.split("/")[:-1] == parts and re.search(q.LICENCE_FILE, p)]
            if files:
                licence, origin = min(files)[2], "/".join(parts)
            if files or not parts:
                break
            parts = parts[:-1]
        out[i] = (name, round(cosine, 6), line, licence, origin)
    return out


def test_same_as_scanning_all_lines_and_climbing(spark):
    docs = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words\nall over"), (3, "a/b/c/COPYING", "x\n\n This is licensed under the GNU General Public License, version 3"),
        (4, "a/b/c/d/e.txt", "more plain text of the kind"), (5, "z/y.txt", "nothing at all"), (6, "a/own.txt", "code here\nAll rights reserved."), (7, "top.txt", None), (8, None, ""),
        (9, "a/b/license.md", "not a licence at all"), (10, "q/LICENCE", "All rights reserved"), (11, "q/LICENSE", "All rights reserved"), (12, "q/a.txt", "the version of words"), (13, "a/b/c/notice", "released under the MIT license\nall rights reserved"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, path string, text string").repartition(4)
    files = q.own_licences(df, ["doc_id", "path"], templates=SMALL)
    got = {r["doc_id"]: (r["own_licence"], round(r["cosine"], 6), r["line"], r["licence"], r["from_dir"]) for r in q.inherit(files).collect()}
    assert got == brute(docs)


def test_odd_rows_and_columns(spark):
    rows = q.scan(odd_docs(spark, "licence", "__dir", "path"), F.lit("a/b")).collect()
    assert len(rows) == 7 and all(r["licence"] is None and r["cosine"] == 0 for r in rows)
    assert q.scan(empty_docs(spark), F.lit(None)).count() == 0


def test_notices_of_the_table_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = q.scan(docs, F.concat_ws("/", "source", F.col("doc_id").cast("string"))).join(docs.select("doc_id", "text"), "doc_id")
    assert got.filter("text rlike 'MIT License' and own_licence <> 'MIT'").count() == 0
    assert got.filter("own_licence is not null and not text rlike '(?i)licen|rights reserved'").count() == 0


TEXTS = {k[1]: t for k, t in q.wide_templates().items() if k[0] == q.TEXT}
GPL2 = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */"""
CODE = "\n".join(f"def fn{i}(x{i}): return value{i} + other{i}" for i in range(300))
WHOLE = [
    ("MIT License", "MIT"), ("Copyright 2020 Some Person. All rights reserved.", "Proprietary"), ("// SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), (GPL2, "GPL-2.0"), (f"import os\n{GPL2}\n{CODE}", "GPL-2.0"),
    (f"The MIT License (MIT)\n\nCopyright (c) 2024 Ann Other\n\n{TEXTS['MIT']}", "MIT"), (f"{CODE}\n# " + TEXTS["ISC"].replace("\n", "\n# ") + CODE, "ISC"),
    (f"Copyright (c) 2001, Foo\nAll rights reserved.\n\n{TEXTS['BSD-2-Clause'].replace('COPYRIGHT HOLDERS', 'FOO PROJECT')}", "BSD-2-Clause"),
    (f"Read this first.\n\n{TEXTS['GPL-3.0']}\n{CODE}", "GPL-3.0"), ("This file is licensed under the\n   Apache License,\n   Version 2.0 by us", "Apache-2.0"),
    ("# SPDX-License-Identifier: Foo-9.9", None), ("the license of my neighbour and all rights of his", None), (CODE, None),
]


def test_texts_headers_and_tags_across_lines(spark):
    docs = [(i, f"d{i}/x", t) for i, (t, _) in enumerate(WHOLE)] + [(100 + i, f"t{i}/LICENSE", TEXTS[n]) for i, n in enumerate(sorted(TEXTS))]
    plain = [(1000 + i, f"p{i}/x", "mit den under the of plain words and all the rest") for i in range(200)]
    rows = {r["doc_id"]: r for r in q.own_licences(spark.createDataFrame(docs + plain, "doc_id long, path string, text string").repartition(3), ["doc_id", "path"]).collect()}
    got = [(t[:60], rows[i]["own_licence"]) for i, (t, _) in enumerate(WHOLE)]
    assert got == [(t[:60], n) for t, n in WHOLE]
    assert [rows[100 + i]["own_licence"] for i in range(len(TEXTS))] == sorted(TEXTS)
    assert rows[5]["line"] == 3 and all(rows[i]["own_licence"] is None for i in range(1000, 1200))


def test_windows_are_those_of_brute_force():
    import numpy as np

    draw = np.random.default_rng(3)
    hashes, size = draw.integers(0, 9, 400).astype(np.uint64), 17
    idf = 1 + hashes.astype(float)
    brute_squares = [sum((c * (1 + w)) ** 2 for w, c in Counter(hashes[i : i + size].tolist()).items()) for i in range(len(hashes) - size + 1)]
    assert np.allclose(q._window_squares(hashes, idf, size), brute_squares)
