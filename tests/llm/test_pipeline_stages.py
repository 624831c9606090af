import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from helpers import words

import corpus_pipeline
from lodestone.llm import common, langmix, registry


def _mixture(grams, p):
    """Backward choice of languages by plain EM of very many rounds."""
    gram, count = np.unique(grams, return_counts=True)
    q, langs, best, top = (p / p.mean(0))[:, gram], list(range(len(p))), None, -np.inf
    while langs:
        pi = np.full(len(langs), 1 / len(langs))
        for _ in range(5000):
            new = pi * (q[langs] @ (count / (pi @ q[langs]))) / len(grams)
            if abs(new - pi).max() < 1e-9:
                break
            pi = new
        value = count @ np.log(pi @ q[langs]) - 0.5 * np.log(max(2, len(grams))) * (len(langs) - 1)
        if value < top:
            break
        top, best = value, pi
        langs.pop(len(langs) - 1 - pi[::-1].argmin())
    return best.max()


def _languages(rows):
    grams = {i: langmix._ngrams(pa.array([r.text], pa.string()))[1] for i, r in enumerate(rows)}
    train = [i for i, r in enumerate(rows) if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({rows[i].lang for i in train})
    p = np.full((len(langs), langmix.BUCKETS), 0.5)
    for i in train:
        p[langs.index(rows[i].lang)] += np.bincount(grams[i], minlength=langmix.BUCKETS)
    p /= p.sum(1, keepdims=True)
    letters = [any(c.isalpha() for c in r.text or "") for r in rows]
    return [r for i, r in enumerate(rows) if letters[i] and len(grams[i]) and _mixture(grams[i], p) >= corpus_pipeline.LEAST_SHARE]


def _words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _covered(text, item, least=5):
    """Words of the item under greedy tiles: the longest common run of free words
    first, of these the one that starts first in the text, then in the item."""
    least, total = min(least, len(item)), 0
    text, item = list(text), list(item)
    while item:
        best, run = (0, 0, 0), [0] * (len(item) + 1)
        for i, w in enumerate(text):
            new = [0] * (len(item) + 1)
            if w is not None:
                for j, v in enumerate(item):
                    if v == w:
                        new[j + 1] = run[j] + 1
                        best = max(best, (new[j + 1], new[j + 1] - i - 1, new[j + 1] - j - 1))
            run = new
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        text[i : i + n], item[j : j + n] = [None] * n, [None] * n
        total += n
    return total


def _clean(rows, items):
    index = {}
    for k, item in enumerate(items):
        width = min(5, len(item))
        for j in range(len(item) - width + 1):
            index.setdefault(tuple(item[j : j + width]), set()).add(k)
    widths = {len(x) for x in index}
    out = []
    for r in rows:
        w = _words(r.text)
        near = set().union(*(index.get(tuple(w[j : j + n]), ()) for n in widths for j in range(len(w) - n + 1)))
        if not any(2 * _covered(w, items[k]) >= len(items[k]) for k in near):
            out.append(r)
    return out


def test_survivors_of_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted(map(repr, rows))
    rows = docs.collect()
    docs = common.table(stages["language_id"](spark, docs, sf), "language")
    assert key(docs.collect()) == key(_languages(rows))
    for name in ("line_dedup", "near_duplicates"):
        docs = common.table(stages[name](spark, docs, sf), name)
    before = docs.collect()
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := _words(r.text))]
    want = _clean(before, items)
    assert len(want) < len(before)
    assert key(stages["decontamination"](spark, docs, sf).collect()) == key(want)

    # the mixture of exactly these documents, by the SQL of the mixing query
    con = duckdb.connect()
    documents = pa.table({c: pa.array([r[c] for r in want], t) for c, t in (("doc_id", pa.int64()), ("source", pa.string()), ("text", pa.string()))})
    con.register("documents", documents)
    names = [c[0] for c in con.execute(registry.oracle_sql()["op3_mix_sources"]).description]
    taken = [dict(zip(names, r)) for r in con.fetchall()]
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    size = {r.doc_id: len(words(r.text)) for r in want}
    assert set(got) <= set(size)
    assert {i: n * size[i] for i, n in got.items() if size[i]} == {r["doc_id"]: r["taken"] for r in taken if r["taken"]}
