import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import rows, table, words

from lodestone.llm import importance, langmix, lattice


def _held(i, folds, part):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == part


def test_lattice_against_brute_force(spark):
    data = rows()
    got = lattice.lattice_scores(table(spark), shard_bytes=20_000).collect()
    assert len(got) == len(data)
    counts, ends = Counter(), 0
    for r in data:
        if not _held(r[0], 5, 1):
            counts.update(words(r[1]))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((repr(r[0]), len(words(r[1])) + 1, sum(counts[w] > 0 for w in words(r[1])) + 1, round(sum(base(counts[w]) for w in words(r[1])) + base(ends), 6)) for r in data)
    assert sorted((repr(g.doc_id), g.n_tokens, g.n_known, round(g.base_score, 6)) for g in got) == want
    assert all(g.train_tokens == n and g.held_out == _held(g.doc_id, 5, 1) and g.score < 0 for g in got)
    alone = {g.doc_id: g.score for g in got if g.doc_id in (30, 31, 32)}
    assert len(set(alone.values())) == 1


def test_lattice_empty(spark):
    assert lattice.lattice_scores(table(spark, [])).collect() == []


def _tiny():
    return lattice.Pieces([b" a", b"b", b" ab", b"a", b" ", b"bb"], np.log([0.2, 0.2, 0.1, 0.1, 0.1, 0.3]))


def _paths(word, pieces):
    table = dict(zip(pieces.strings, pieces.weights))
    if not word:
        return [(0.0, ())]
    return [(table[word[:i]] + w, (word[:i], *p)) for i in range(1, len(word) + 1) if word[:i] in table for w, p in _paths(word[i:], pieces)]


def test_forward_backward_sums_all_segmentations():
    pieces, texts = _tiny(), [b"abb", b"ab", b"bbb", b"a"]
    counts = np.array([3.0, 1.0, 2.0, 5.0])
    got, used = lattice.word_likelihoods(*lattice._spans(pa.array(texts, pa.binary())), pieces, counts)
    want_used = Counter()
    for t, c, g in zip(texts, counts, got):
        paths = _paths(b" " + t, pieces)
        total = math.log(sum(math.exp(w) for w, _ in paths))
        assert abs(total - g) < 1e-12
        for w, p in paths:
            for x in p:
                want_used[x] += c * math.exp(w - total)
    assert np.allclose(used, [want_used[s] for s in pieces.strings])


def test_language_rules(spark):
    got = {}
    for r in langmix.identify(table(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len([x for v in got.values() for x in v]) == len(rows())
    for i in (30, 31, 32, 35):
        assert got[i][0].lang_pred == "und" and got[i][0].score == 0
    assert all(0 <= x.score <= 1 and x.lang_pred in ("en", "de", "und") for v in got.values() for x in v)
    assert all(x.held_out == _held(x.doc_id, 4, 2) for v in got.values() for x in v)
    assert len({(x.lang_pred, x.score) for x in got[3]}) == 1
    kept = {r.doc_id for r in langmix.keep_identified(table(spark), 0.3).collect()}
    assert kept == set(got) - {30, 31, 32, 35}


def test_language_empty_and_untrained(spark):
    assert langmix.identify(table(spark, [])).collect() == []
    none = [(1, "words here", None, None, None, None, None, None)]
    assert [r.lang_pred for r in langmix.identify(table(spark, none)).collect()] == ["und"]


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    j = langmix.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in j) >= 0.97 * len(j)


def test_mixture_shares():
    p = np.full((2, langmix.BUCKETS), 1e-6)
    p[0, :50], p[1, 50:100] = 0.02, 0.02
    p /= p.sum(1, keepdims=True)
    grams = np.concatenate([np.arange(30), np.arange(50, 60), np.arange(40)])
    docs = np.repeat([0, 0, 1], [30, 10, 40])
    shares = langmix.mixtures(docs, grams, 2, p)
    assert np.allclose(shares[0], [0.75, 0.25], atol=0.02) and shares[1].tolist() == [1.0, 0.0]


def test_importance(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(24)] + [(None, 1, 0), (999, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = importance.resample(table(spark), labels).collect()
    assert len(got) == len(rows())
    features = {r.doc_id: r.n_features for r in got if r.doc_id not in (None, 36)}
    for r in rows():
        if r[0] in features:
            assert features[r[0]] == max(0, 2 * len(words(r[1])) - 1)
    assert all(r.log_weight == 0 for r in got if r.n_features == 0)
    chosen = sorted((r.gumbel_key for r in got if r.selected), reverse=True)
    assert chosen == sorted((r.gumbel_key for r in got), reverse=True)[: round(len(got) / 2)]
    assert importance.resample(table(spark, []), labels).collect() == []


def test_importance_prefers_target(spark):
    data = [(i, ("good words stand here " if i % 2 else "bad stuff is there ") * 20, None, None, None, None, None, None) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 100, 2)], "doc_id long, quality int, toxic int")
    got = importance.resample(table(spark, data), labels).collect()
    assert sum(r.selected for r in got) == 100 and sum(r.selected and r.doc_id % 2 for r in got) >= 90


def test_top_k(spark):
    values = [-5.0, 3.0, 3.0, 8.0, -1000.0, 0.0, -0.0, 7.0, 1e300, -1e300, 3.0000000001, 1e-300]
    bits = importance.ordered(np.array(values)).tolist()
    assert sorted(values) == [v for _, v in sorted(zip(bits, values))]
    df = spark.createDataFrame([(v, b, i % 2, i) for i, (v, b) in enumerate(zip(values, bits))], "key double, bits long, tie long, place long")
    for k in range(len(values) + 2):
        got = sorted(r.place for r in importance.top_k(df, ["bits", "tie", "place"], k, "sel").where("sel").collect())
        want = sorted(range(len(values)), key=lambda i: (bits[i], i % 2, i), reverse=True)[:k]
        assert got == sorted(want)


def test_exact_share_of_equal_rows_and_rows_without_ids(spark):
    labels = spark.createDataFrame([(-1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    same = [(1, "the same words here", None, None, None, None, None, None)] * 10
    assert sum(r.selected for r in importance.resample(table(spark, same), labels, share=0.5).collect()) == 5
    data = [(None, f"words of row {i}", None, None, None, None, None, None) for i in range(40)] + [(3, "target words", None, None, None, None, None, None)]
    got = importance.resample(table(spark, data), labels).collect()
    assert sum(r.selected for r in got) == 20 and len({r.gumbel_key - r.log_weight for r in got}) == 41
    target = next(r for r in got if r.doc_id == 3)
    assert all(r.log_weight < target.log_weight for r in got if r.doc_id is None)
