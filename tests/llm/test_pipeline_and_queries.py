import math
import re
from collections import defaultdict

import duckdb
import pytest
from helpers import words

import corpus_pipeline
from lodestone.llm import langmix, mixing, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want


def _shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _loose(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    rows = {r.doc_id: r for r in docs.collect()}

    langs = {r.doc_id: r for r in langmix.identify(docs).collect()}
    texts = {i: r.text or "" for i, r in rows.items() if langs[i].lang_pred != "und" and langs[i].score >= corpus_pipeline.LEAST_SHARE}

    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 5}
    texts = {i: "\n".join(x for x in t.split("\n") if keeper.get(key(x), i) <= i) for i, t in texts.items()}

    sets, parent = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        both = defaultdict(int)
        for g in s:
            for j in index[g]:
                both[j] += j < i
        for j, n in both.items():
            if n and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    texts = {i: t for i, t in texts.items() if find(i) == i}

    bench = [_loose(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seeds = {tuple(b[i : i + 5]) for b in bench for i in range(len(b) - 4)}
    clean = {}
    for i, t in texts.items():
        w = _loose(t)
        if not any(tuple(w[j : j + 5]) in seeds for j in range(len(w) - 4)):
            clean[i] = t
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += 1
        assert r.text == texts[r.doc_id]
    # a document that shares a seed may stay if it covers less than half an item
    assert set(got) <= set(texts)

    final = spark.createDataFrame([(i, rows[i].source, texts[i]) for i in set(got) | set(clean)], "doc_id long, source string, text string")
    want = {r.doc_id: r.copies for r in mixing.systematic_mix(final).collect()}
    if set(clean) >= set(got):
        assert {i: n for i, n in want.items() if n} == dict(got)
    size = sum(len(words(texts[i])) * n for i, n in got.items())
    assert math.isclose(size, sum(len(words(texts[i])) for i in want), rel_tol=0.35)


def test_stage_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_empty_documents(spark, sf, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
