import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, rows, table

from lodestone.llm import periodic_runs
from lodestone.llm.registry import op12_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(doc_id, text, repeat):
    w = WORD.findall(text or "")
    n = len(w)
    if repeat and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a, e = g % n, 3 + g % 8
        p = 1 + (n - a) // e
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # smaller periods come first
            i = max(j, i) + 1
    runs = sorted((s, x, q) for (s, x), q in found.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, x, q in runs for i in range(s + q, s + x)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, n, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, kept)


def texts():
    rng = random.Random(11)
    out = ["a " * 6, "a " * 5, "a b " * 4, "A a " * 40, "x " * 100 + "y", ("a a b " * 5) + "c", " ".join("ab"[i % 3 == 0] for i in range(50)), "p q r s " * 4 + "p q", "é ü " * 9]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            parts += unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("kw", [{}, {"repeat": True}, {"long_bytes": 20, "lags": 2}, {"long_bytes": 20, "lags": 1, "repeat": True}])
def test_runs_against_brute_force(spark, kw):
    data = rows() + [(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(texts())] + [(None, "a b " * 30, None, None, None, None, None, None)] * 2
    got = sorted(map(tuple, periodic_runs.periodic_runs(table(spark, data), **kw).collect()), key=repr)
    assert got == sorted((brute(r[0], r[1], kw.get("repeat", False)) for r in data), key=repr)


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(table(spark, [])).collect() == []


def test_blocks_and_low_bytes():
    """More words than low bytes and than a block of comparisons."""
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 5000, 9000)
    words = periodic_runs.word_numbers(np.concatenate([rng.integers(0, 5000, 777), np.tile(unit, 5), unit[:40], [6000, 6001]]).astype(np.uint64))
    assert periodic_runs.runs_of(periodic_runs.stretches(words, 1, len(words))).tolist() == [[777, 45_040, 9000]]


def test_one_word_a_hundred_thousand_times(spark):
    df = spark.createDataFrame([(1, "so " * 100_000 + "end", *[None] * 6)], SCHEMA)
    got = periodic_runs.periodic_runs(df, long_bytes=100_000).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.collapsed) for r in got] == [(1, 0, 100_000, 1, "so end")]


def test_query(spark, sf):
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = brute(d.doc_id, d.text, True)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256) == want[2:8]
        assert r.collapsed_sha256 == hashlib.sha256(want[8].encode()).hexdigest()
