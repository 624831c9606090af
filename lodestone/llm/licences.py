"""Licence scan: TF-IDF cosines of lines, paragraphs, leading comments and whole
files to licence templates, then inheritance from the nearest ancestor directory.

Every line of every whole file is compared with a set of licence notices and
standard headers as a sparse TF-IDF vector; paragraphs, the leading comment and
the file as a whole are compared with whole licence texts too. Only terms of the
templates can add to a dot product; the norm needs the document counts of all
words, so units that may reach the threshold send their other words, which are
counted in one more scan and joined back by hash (64 bits).
A file whose best unit reaches the threshold has that licence itself. Licence
files speak for their directory: a file without a licence of its own takes that
of the nearest directory above it that has one, by an equi-join of the ancestor
paths of all distinct directories.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_MARK, U64, Words, drop, slices, table

#: Notices and standard headers by which files state their licence.
_GNU = (
    ("GPL", "General", "2", "GPL-2.0"), ("GPL", "General", "3", "GPL-3.0"), ("LGPL", "Lesser General", "2.1", "LGPL-2.1"), ("LGPL", "Library General", "2", "LGPL-2.0"),
    ("LGPL", "Lesser General", "3", "LGPL-3.0"), ("AGPL", "Affero General", "3", "AGPL-3.0"),
)
_SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Proprietary", "All rights reserved."),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for _, kind, v, name in _GNU),
    *((name, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License version {v} as published by the Free Software Foundation.") for _, kind, v, name in _GNU),
    *((name, f"GNU {kind.upper()} PUBLIC LICENSE Version {v}") for _, kind, v, name in _GNU),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in _SPDX),
)
THRESHOLD = 0.8
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"
#: The leading comments of a file, after an interpreter line.
HEADER = re.compile(rb"\s*(?:/\*.*?\*/\s*|<!--.*?-->\s*|\"\"\".*?\"\"\"\s*|'''.*?'''\s*|(?:#|//|--|;|%|\.\.|\"|rem\b|dnl\b)[^\n]*\s*)+", re.S)


@cache
def licence_texts() -> tuple[tuple[str, str], ...]:
    """Whole licence texts, by file name. A library without them would miss whole
    licences without a word, so it raises."""
    folder = Path(__file__).resolve().parent / "licence_texts"
    if not any(folder.glob("*.txt")):
        raise FileNotFoundError(f"no licence texts in {folder}")
    return tuple((p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt")))


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        words = Words(pa.array([t for _, t in templates], pa.string()), IS_MARK)
        self.terms, at = np.unique(words.hashes(), return_inverse=True)
        owner = np.repeat(np.arange(len(templates)), np.diff(words.bounds))
        self.tf = np.zeros((len(templates), len(self.terms)))
        np.add.at(self.tf, (owner, at), 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for other words."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)


def _lines(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a batch, the line of each (numbered over the batch) and the
    first line of each text."""
    words = Words(column, IS_MARK)
    feeds = np.flatnonzero(words.data == 0x0A)
    starts = np.sort(np.concatenate([words.offsets[:-1], feeds]), kind="stable")
    line = np.searchsorted(starts, words.starts, "right") - 1
    return words, line, np.searchsorted(starts, words.offsets[:-1], "left")


def _document_counts(t: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(t.terms), np.int64)
        for batch in slices(batches):
            words = Words(batch.column(batch.schema.get_field_index("text")), IS_MARK)
            term = t.find(words.hashes())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))
            pairs = np.unique(np.stack([owner[term >= 0], term[term >= 0]], 1), axis=0)
            df += np.bincount(pairs[:, 1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


def _units(words: Words, line: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word, end word, line in the text, whether a line) of every
    line, and of every paragraph, leading comment and whole text of more lines."""
    n = len(first)
    owner = np.repeat(np.arange(n), np.diff(words.bounds))
    every, out = len(owner), []
    turn = np.flatnonzero(np.diff(line, prepend=-1))
    out.append((turn, np.append(turn[1:], every), True))
    gap = np.flatnonzero((np.diff(line, prepend=-9) > 1) | (np.diff(owner, prepend=-1) > 0))
    out.append((gap, np.append(gap[1:], every), False))
    full = np.flatnonzero(np.diff(words.bounds))
    out.append((words.bounds[full], words.bounds[full + 1], False))
    data, ends = words.data.tobytes(), []
    for i in full:
        found = HEADER.match(data, words.offsets[i], words.offsets[i + 1])
        ends.append(np.searchsorted(words.starts, found.end()) if found else words.bounds[i])
    ends = np.array(ends, np.int64)
    some = ends > words.bounds[full]
    out.append((words.bounds[full][some], ends[some], False))
    begin, end, single = (np.concatenate(x) for x in zip(*((a, b, np.full(len(a), c)) for a, b, c in out)))
    more = single | (line[begin] != line[end - 1]) if every else single
    begin, end, single = begin[more], end[more], single[more]
    return owner[begin], begin, end, line[begin] - first[owner[begin]], single


#: Units whose score waits for the counts of their other words.
OPEN = "array<struct<name: string, rank: int, dot: double, known: double, line: long, words: array<struct<word: long, tf: long>>>>"
_OPEN = pa.list_(pa.struct([
    ("name", pa.string()), ("rank", pa.int32()), ("dot", pa.float64()), ("known", pa.float64()), ("line", pa.int64()),
    ("words", pa.list_(pa.struct([("word", pa.int64()), ("tf", pa.int64())]))),
]))


def _scan(t: Templates, idf: np.ndarray, threshold: float, short: int):
    """Scores of the units; lines are compared with the first ``short``
    templates, larger units with all. No word weighs less than 1, so a unit
    whose other words would have to weigh less is left out; the others are open."""
    weight = t.tf * idf
    weight /= np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-300)
    weight = np.ascontiguousarray(weight.T)
    ranks = [2 * (name != "Proprietary") + (i >= short) for i, name in enumerate(t.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            words, line, first = _lines(batch.column(batch.schema.get_field_index("text")))
            h = words.hashes()
            n = batch.num_rows
            best: list = [None] * n
            waiting: list[list] = [[] for _ in range(n)]
            for owner, at, template, dot, known, others in _candidates(t.find(h), h, _units(words, line, first)):
                if others is None:
                    value = dot / np.sqrt(known)
                    now = (ranks[template], round(value, 12), -at)
                    if value >= threshold and (best[owner] is None or now > best[owner][0]):
                        best[owner] = now, t.names[template], value, at
                else:
                    most = dot / np.sqrt(known + (others[1] ** 2).sum())
                    waiting[owner].append((ranks[template], most, t.names[template], dot, known, at, others))
            found = [b[1:] if b else (None, 0.0, -1) for b in best]
            opened = [
                [
                    {"name": name, "rank": rank, "dot": dot, "known": known, "line": at, "words": [{"word": w, "tf": c} for w, c in zip(*(x.tolist() for x in others))]}
                    for rank, most, name, dot, known, at, others in own
                    if best[i] is None or (rank, most + 1e-9) >= best[i][0][:2]
                ]
                for i, own in enumerate(waiting)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([min(x[1], 1.0) for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64()),
                    pa.array([b[0][0] if b else -1 for b in best], pa.int32()), pa.array(key + np.arange(n)), pa.array(opened, _OPEN),
                ],
                names=["file_id", "path", "own", "score", "line", "rank", "key", "open"],
            )
            key += n

    def _candidates(term: np.ndarray, h: np.ndarray, units: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        """(text, line, template, dot product, squared norm of the template terms,
        other words and their counts or None) of the units that may reach the threshold."""
        owner, begin, end, at, single = units
        seen = np.concatenate([[0], np.cumsum(term >= 0)])
        hits = seen[end] - seen[begin]
        # no cosine is above the share of the template terms in a unit's norm
        most = hits**2 * (idf.max() ** 2 if len(idf) else 0)
        for i in np.flatnonzero((hits > 0) & (most >= threshold**2 * (most + (end - begin - hits)) - 1e-9)):
            mine = term[begin[i] : end[i]]
            terms, tf = np.unique(mine[mine >= 0], return_counts=True)
            v = tf * idf[terms]
            known, others = (v**2).sum(), None
            norm = known
            if hits[i] < len(mine):
                norm = known + len(mine) - hits[i]
                if known < threshold**2 * norm - 1e-9:
                    continue
            dot = v @ weight[terms, : short if single[i] else len(t.names)]
            template = int(dot.argmax())
            if dot[template] < (threshold - 1e-9) * np.sqrt(norm):
                continue
            if hits[i] < len(mine):
                others = np.unique(h[begin[i] : end[i]][mine < 0].view(np.int64), return_counts=True)
                if dot[template] < (threshold - 1e-9) * np.sqrt(known + (others[1] ** 2).sum()):
                    continue
            yield int(owner[i]), int(at[i]), template, float(dot[template]), float(known), others

    return run


_NEED_BITS = 20


def _word_counts(need: np.ndarray):
    """Documents of every word whose hash begins like one that is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(batch.schema.get_field_index("text")), IS_MARK)
            h = words.hashes()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))
            keep = need[(h >> U64(64 - _NEED_BITS)).astype(np.int64)]
            h, owner = h[keep], owner[keep]
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            word, df = np.unique(h[once].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(df)], names=["word", "df"])

    return run


def _close(f: DataFrame, scanned: DataFrame, n: int, threshold: float) -> DataFrame:
    """``scanned`` with the open units scored by the document counts of their
    other words, which are joined by hash."""
    units = scanned.where(F.size("open") > 0).select("key", F.posexplode("open").alias("unit", "u")).select("key", "unit", "u.*")
    each = units.select("key", "unit", F.explode("words").alias("w")).select("key", "unit", "w.*")
    prefixes = each.select(F.shiftrightunsigned("word", 64 - _NEED_BITS).alias("p")).distinct().collect()  # 2^20 at most
    if prefixes:
        need = np.zeros(1 << _NEED_BITS, bool)
        need[[r["p"] for r in prefixes]] = True
        counts = f.select("text").mapInArrow(_word_counts(need), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
        weight = F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1
        norms = each.join(counts, "word").groupBy("key", "unit").agg(F.sum((F.col("tf") * weight) ** 2).alias("others"))
        scored = units.join(norms, ["key", "unit"]).withColumn("cosine", F.least(F.lit(1.0), F.col("dot") / F.sqrt(F.col("known") + F.col("others")))).where(F.col("cosine") >= threshold)
        top = F.max(F.struct("rank", F.round("cosine", 12).alias("r"), (-F.col("line")).alias("l"), "name", "cosine")).alias("top")
        scanned = scanned.join(scored.groupBy("key").agg(top), "key", "left")
        now = F.struct("rank", F.round("score", 12).alias("r"), (-F.col("line")).alias("l"))
        wins = F.coalesce(F.struct("top.rank", "top.r", "top.l") > now, F.lit(False)) & F.col("top").isNotNull()
        pick = lambda x, c: F.when(wins, F.col(x)).otherwise(F.col(c)).alias(c)
        scanned = scanned.select("file_id", "path", pick("top.name", "own"), pick("top.cosine", "score"), F.when(wins, -F.col("top.l")).otherwise(F.col("line")).alias("line"))
    return table(scanned.select("file_id", "path", "own", "score", "line"), "licences")


def scan_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(file_id, path, own, score, line, licence, origin, holder) of every row of
    (file_id, path, text).

    own is the licence of the file's best unit: a line against ``templates``, or
    a paragraph, the leading comment or the whole file against these and
    ``texts`` (whole licences; None: those of ``licence_texts``). A licence goes
    before a mere "all rights reserved" and a whole text before a notice (licences
    share sentences), then the best cosine counts, then the first unit; score is its cosine, line its first line from 0 (-1: none). licence is own, or else
    that of the nearest directory above which a licence file states; origin is
    own, inherited or none; holder the directory it comes from. If several
    licence files of a directory state one, the best score counts, then the
    first licence name.

    Defined cases: null and empty texts have no licence of their own; a null
    path belongs to no directory and inherits nothing; repeated rows are kept;
    other columns are ignored; an empty table gives an empty result. The root
    directory is the empty path.
    """
    texts = licence_texts() if texts is None else texts
    t = Templates((*templates, *texts))
    f = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    df = np.zeros(len(t.terms))
    counts = f.select("text").mapInArrow(_document_counts(t), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # one row a template term
        df[r["term"]] = r["df"]
    n = f.count()
    idf = np.log((n + 1) / (df + 1)) + 1
    scanned = table(f.mapInArrow(_scan(t, idf, threshold, len(templates)), f"file_id long, path string, own string, score double, line long, rank int, key long, open {OPEN}"), "units")
    own = _close(f, scanned, n, threshold)
    drop(scanned)
    own = own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    stated = own.where(F.col("own").isNotNull() & F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("o")))
    holders = stated.groupBy("dir").agg(best["o"].alias("given")).withColumnRenamed("dir", "holder")
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    level = F.explode(F.sequence(F.lit(0), F.size(parts)))
    above = own.select("dir").where("dir IS NOT NULL").distinct().select("dir", parts.alias("parts"), level.alias("level"))
    above = above.select("dir", "level", F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("holder"))
    nearest = above.join(holders, "holder").groupBy("dir").agg(F.max(F.struct("level", "holder", "given")).alias("top"))
    nearest = table(nearest, "nearest")  # the join below may then split a directory of very many files
    out = own.join(nearest, "dir", "left")
    return out.select(
        "file_id", "path", "own", "score", "line",
        F.coalesce("own", "top.given").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("top").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("top.holder")).alias("holder"),
    )
