import math
import re
from collections import Counter

from lodestone.llm import licences

SCHEMA = "file_id long, path string, text string"
GPL_HEADER = """#!/usr/bin/env python
# Some program
# Copyright (C) 2019 Jane Roe
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

import os
"""


def _scan(spark, files):
    return {r.file_id: r for r in licences.scan_licences(spark.createDataFrame(files, SCHEMA)).collect()}


def test_whole_licence_files_and_headers(spark):
    whole = dict(licences.licence_texts())
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"} <= set(whole)
    files = [(i, f"{name}/COPYING", "Copyright (c) 2011 Jane Roe\n\n" + text) for i, (name, text) in enumerate(whole.items())]
    files += [(100 + i, f"{name}/src/x.c", "int main") for i, name in enumerate(whole)]
    bsd = "/*\n * Copyright (c) 2011 Jane Roe\n * All rights reserved.\n *\n" + "".join(f" * {x}\n" for x in whole["BSD-2-Clause"].split("\n")) + " */\n" + "int f(int x);\n" * 400
    files += [(200, "h/a.py", GPL_HEADER), (201, "h/b.c", "// SPDX-License-Identifier: MIT\nint x;"), (202, "h/c.c", bsd), (203, "h/d.c", GPL_HEADER.replace("General", "Lesser General"))]
    files += [(204, "h/e.c", "int words = 3;\n\nall of the code and the rest of it")]
    got = _scan(spark, files)
    for i, name in enumerate(whole):
        assert (got[i].own, got[100 + i].licence, got[100 + i].origin) == (name, name, "inherited")
    assert [got[i].own for i in range(200, 205)] == ["GPL-3.0", "MIT", "BSD-2-Clause", "LGPL-3.0", None]


def test_cosines_with_the_counts_of_all_words(spark):
    notices = (("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."))
    lines = [
        "This file is licensed under the Apache License, Version 2.0.", "this this file: licensed under the Apache License, Version 2.0", "Zyx: released under the MIT License.", "released under the MIT license, file",
        "file", "this is a file", "under the file", "Released under the MIT License.", "licensed under apache",
    ]
    common = [f"this file is of the kind {i % 3}" for i in range(600)]
    texts = [x for i, line in enumerate(lines) for x in [line] * (3 if i == 3 else 1)] + ["Intro\n" + lines[0], lines[0] + "\n" + lines[7], None, ""] + common
    split = lambda x: re.findall(r"[a-z0-9]+", (x or "").lower())
    df = Counter(w for x in texts for w in set(split(x)))
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1
    vector = lambda x: {w: c * idf(w) for w, c in Counter(split(x)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    table = spark.createDataFrame([(i, f"d{i}/x", x) for i, x in enumerate(texts)], SCHEMA)
    got = {r.file_id: r for r in licences.scan_licences(table, notices, texts=()).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        units = [*enumerate((text or "").split("\n")), (0, text)]
        best = max(((cosine(vector(u), vector(t)), -at, name) for at, u in units if split(u) for name, t in notices), default=(0, 1, None), key=lambda x: (round(x[0], 9), x[1]))
        if best[0] < licences.THRESHOLD:
            best = (0, 1, None)
        assert got[i].own == best[2] and got[i].line == -best[1] and abs(got[i].score - best[0]) < 1e-9, (text, best, got[i])
    assert got[0].own == "Apache-2.0"


def test_inheritance_against_brute_force(spark):
    import random

    rng = random.Random(9)
    notes = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    folders = ["", "a", "a/b", "a/b/c", "a/b/c/d", "e", "e/f"]
    files = []
    for i in range(120):
        name, text = f"f{i}.py", "plain code"
        if rng.random() < 0.08:
            name, text = f"LICENSE-{i}", notes[rng.choice(sorted(notes))]
        elif rng.random() < 0.1:
            text = notes["MIT"]
        folder = rng.choice(folders)
        files.append((i, f"{folder}/{name}" if folder else name, text))
    files += [(200 + i, f"flat/x{i}.py", "plain code") for i in range(300)] + [(600, "flat/LICENSE", notes["MIT"])]
    own = {i: next((n for n, t in notes.items() if t == text), None) for i, _, text in files}
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    given = {}
    for i, path, _ in files:
        if own[i] and path.rsplit("/", 1)[-1].startswith("LICENSE"):
            given.setdefault(folder(path), []).append(own[i])
    got = {r.file_id: r for r in licences.scan_licences(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    score = {r.own: r.score for r in got.values() if r.own}
    for i, path, _ in files:
        up, want = folder(path), (own[i], "own", None) if own[i] else None
        while want is None:
            if up in given:
                want = min(given[up], key=lambda n: (-score[n], n)), "inherited", up
            elif not up:
                want = None, "none", None
            up = folder(up)
        assert (got[i].licence, got[i].origin, got[i].holder) == want
