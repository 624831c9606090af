import hashlib
import math
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import rows, table, words

from lodestone.llm import licences, media, mixing, preference, tiling


def test_media_round_trip(spark):
    got = media.media_features(media.to_media(table(spark))).collect()
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((repr(r[0]), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((repr(g.doc_id), g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in got) == sorted(want)
    assert all(g.intact and len(g.feature) == 16 for g in got)
    assert media.media_features(media.to_media(table(spark, []))).collect() == []


def test_png_rejects_damage():
    png = media.encode_png(media.payload_samples(b"some text " * 50))
    assert media.decode_png(png).tobytes().startswith(b"some text ")
    for at in (3, 20, len(png) // 2, len(png) - 2):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(bad))
    with pytest.raises(media.MediaError):
        media.decode_png(png[:-6])


def _filtered(samples, kinds):
    out, before = [], np.zeros(samples.shape[1], int)
    for row, kind in zip(samples.astype(int), kinds):
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append([kind, *line])
        before = row
    return np.array(out, np.uint8)


def test_all_row_filters():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (40, 9), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40)
    assert (media.unfilter(_filtered(samples, kinds)) == samples).all()
    assert struct.unpack(">I", media.encode_png(samples)[16:20])[0] == 9


def test_hash_of_similar_images():
    text = ("the quick brown fox jumps over the lazy dog " * 60).encode()
    a, b, c = (media.dct_hash(media.payload_samples(t)) for t in (text, text[:-30] + b"x" * 30, bytes(range(256)) * 10))
    apart = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert apart(a, b) < apart(a, c)


def _targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(w), {}
    while free:
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = {n for n in free if share[n] > cap * sizes[n] + 1e-9}
        if not over:
            return out | share
        for n in over:
            out[n] = cap * sizes[n]
            left -= out[n]
        free -= over
    return out


def test_mixing_against_brute_force(spark):
    got = mixing.systematic_mix(table(spark)).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    want = _targets(sizes, (1, 2, 3), 3)
    by = defaultdict(list)
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - want.get(g.source, 0)) < 1e-6 and 0 <= g.copies <= 3
        by[g.source].append(g)
    for s, gs in by.items():
        if want[s]:
            expected = len(gs) * want[s] / sizes[s]
            assert math.floor(expected) <= sum(g.copies for g in gs) <= math.ceil(expected)
    again = mixing.systematic_mix(table(spark).repartition(7)).collect()
    key = lambda x: sorted((repr(g.doc_id), g.size, g.copies) for g in x)
    assert key(got) == key(again)
    assert mixing.systematic_mix(table(spark, [])).collect() == []


def test_sources_without_words_keep_their_turn(spark):
    data = [(i, s, t) for i, (s, t) in enumerate([("a", "w " * 10)] * 100 + [("b", ""), ("b", None)] + [("c", "w " * 10)] * 100)]
    got = mixing.systematic_mix(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()
    assert {(g.source, g.target) for g in got} == {("a", 500.0), ("b", 0.0), ("c", 1500.0)}
    assert {g.copies for g in got if g.source == "b"} == {0}


def test_many_sources_over_ranges(spark):
    sizes = {f"h{i:03}": (i * 37) % 50 for i in range(400)} | {None: 9}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = _targets(sizes, (1, 2, 3), 3)
    assert all(abs(g.target - want[g.source]) < 1e-9 for g in got) and len(got) == 401


def test_mixture_of_rows_without_ids_and_repeated_ids(spark):
    data = [(None, "a", "same words here", i % 2) for i in range(60)] + [(None, "b", "same words here", 0)] * 60 + [(7, "c", f"text {i} here", 0) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, copy int")
    got = mixing.mixture(docs).collect()
    per = defaultdict(int)
    for g in got:
        per[g.source] += 1
    assert all(abs(per[s] - n) <= 1 for s, n in {"a": 30, "b": 60, "c": 90}.items())
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    rows = defaultdict(int)
    for g in got:
        if g.source == "c":
            rows[g.text] += 1
    assert set(rows.values()) <= {1, 2}
    assert mixing.mixture(docs.limit(0)).collect() == []


def test_mixture_emits_copies(spark):
    data = [(i, "some words here", "en", f"s{i % 3}", 1, None, None, None) for i in range(90)]
    got = mixing.mixture(table(spark, data)).collect()
    per = defaultdict(int)
    for g in got:
        per[g.source] += 1
    assert len(got) == 90 and all(abs(per[s] - n) <= 1 for s, n in {"s0": 15, "s1": 30, "s2": 45}.items())


def _pairs():
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "A"), (2, 0, "user", "x"), (3, 0, None, None), (3, 1, "assistant", "same"), (4, 0, "user", "only"), (None, 0, "user", "n"), (1, None, "user", "n"), (1, 0, "user", "hi")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "B"), (1, 4, "user", "bye"), (2, 0, "user", "y"), (3, 0, None, None), (3, 1, "assistant", "same"), (5, 0, "user", "z")]
    return a, b


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, mask string, part int"
    a, b = (spark.createDataFrame([(*r, "extra", 0) for r in side], schema) for side in _pairs())
    t = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    shared = t("user", "hi") + t("assistant", "yes") + t("user", "more")
    want = [
        (1, 0, shared, [t("assistant", "A")], [1], [t("assistant", "B"), t("user", "bye")], [1, 0], 3),
        (2, 0, "", [t("user", "x")], [0], [t("user", "y")], [0], 0), (3, 0, t("unknown", "") + t("assistant", "same"), [], [], [], [], 2),
    ]
    assert sorted(map(tuple, preference.format_preferences(a, b).collect())) == want
    # numbers that begin elsewhere, and rows of two turns
    later = b.withColumn("turn", b.turn + 5)
    assert sorted(map(tuple, preference.format_preferences(a, later).collect())) == want
    parts = sorted(map(tuple, preference.format_preferences(a, b, stretch=2).collect()))
    assert [p[:2] for p in parts] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)] and "".join(p[2] for p in parts if p[0] == 1) == shared
    assert parts[1][3] == [t("assistant", "A")] and parts[1][5] + parts[2][5] == want[0][5]
    assert preference.format_preferences(a.limit(0), b).collect() == []


PASSAGE = "in what year did the tall engineer finish the second bridge over the quiet river near the old mill town"


def test_tiles_of_reordered_text():
    import pyarrow as pa

    from lodestone.llm.common import Words

    def hashes(t):
        return Words(pa.array([t])).hashes()

    w = PASSAGE.split()
    moved = " ".join(["x", "y", *w[10:], "and", *w[:10], "z"])
    found = tiling.tiles(hashes(moved), hashes(PASSAGE), 5)
    assert sorted(n for *_, n in found) == [10, 10]
    assert tiling.tiles(hashes("nothing in common"), hashes(PASSAGE), 5) == []
    twice = tiling.tiles(hashes(PASSAGE + " " + PASSAGE), hashes(PASSAGE), 5)
    assert twice == [(0, 0, 20)]


def test_decontamination(spark):
    w = PASSAGE.upper().split()
    docs = [
        (1, "start " + PASSAGE + " end"), (2, ", ".join(w[9:]) + "! " + "; ".join(w[:9])), (3, "the quiet river near the old house stood"), (4, None), (5, ""),
        (6, " ".join(w[:5]) + " filler " * 30), (7, "tiny test"), (None, PASSAGE),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, PASSAGE), (11, "tiny test"), (12, None), (13, ""), (14, PASSAGE)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.coverage, r.tiles) for r in tiling.contaminations(df, bench).collect()), key=repr)
    assert got == sorted([(i, j, 1.0, 2 if i == 2 else 1) for i in (1, 2, None) for j in (10, 14)] + [(7, 11, 1.0, 1)], key=repr)
    blocks = sorted(((r.doc_id, r.item_id, r.coverage, r.tiles) for r in tiling.contaminations(df, bench, block_bytes=1).collect()), key=repr)
    assert blocks == got
    assert {r.doc_id for r in tiling.decontaminate(df, bench).collect()} == {3, 4, 5, 6}
    assert tiling.contaminations(df.limit(0), bench).collect() == [] and tiling.decontaminate(df, bench.limit(0)).count() == 8


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "code without notice"), (3, "a/b/c/y.py", "more code"), (4, "a/b/COPYING.txt", "Intro\nLicensed under the Apache License, Version 2.0.\n"),
        (5, "z.py", "code"), (6, "a/b/own.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), (7, None, "All rights reserved."), (8, "a/q", None), (9, "a/r", ""), (2, "a/x.py", "code without notice"),
    ]
    df = spark.createDataFrame([(*f, "e") for f in files], "file_id long, path string, text string, dir string")
    got = sorted(((r.file_id, r.licence, r.origin, r.holder) for r in licences.scan_licences(df).collect()), key=repr)
    assert got == sorted([
        (1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "inherited", "a/b"), (4, "Apache-2.0", "own", None), (5, None, "none", None),
        (6, "GPL-3.0", "own", None), (7, "Proprietary", "own", None), (8, "MIT", "inherited", "a"), (9, "MIT", "inherited", "a"),
    ], key=repr)
    assert licences.scan_licences(df.limit(0)).collect() == []


def test_licence_cosines_against_brute_force(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.file_id: r for r in licences.scan_licences(docs.selectExpr("doc_id AS file_id", "'d/' || doc_id AS path", "text")).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    terms = sorted({w for _, t in licences.TEMPLATES for w in split(t)})
    n = len(texts)
    df = {w: sum(w in set(split(t)) for t in texts.values()) for w in terms}
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1

    def vector(tokens):
        v = defaultdict(float)
        for i, w in enumerate(tokens):
            v[w if w in df else ("other", i)] += idf(w)
        return v

    def cosine(a, b):
        dot = sum(x * b.get(k, 0) for k, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    templates = [(name, vector(split(t))) for name, t in licences.TEMPLATES]
    for i, text in texts.items():
        best = max(((cosine(vector(split(line)), v), name) for line in text.split("\n") if split(line) for name, v in templates), default=(0, None))
        assert (got[i].own is not None) == (best[0] >= licences.THRESHOLD), (i, best)
        if got[i].own:
            assert abs(got[i].score - best[0]) < 1e-9
