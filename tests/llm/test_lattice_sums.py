import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows, table, words

from lodestone.llm import lattice


def _plain(word, weight, longest):
    """Log sums before and behind every position, by the recursion itself."""
    n = len(word)
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for t in range(1, n + 1):
        v = [alpha[t - b] + weight[word[t - b : t]] for b in range(1, min(t, longest) + 1) if word[t - b : t] in weight]
        m = max(v)
        alpha[t] = m + math.log(sum(math.exp(x - m) for x in v))
    for t in range(n - 1, -1, -1):
        v = [beta[t + b] + weight[word[t : t + b]] for b in range(1, min(n - t, longest) + 1) if word[t : t + b] in weight]
        m = max(v)
        beta[t] = m + math.log(sum(math.exp(x - m) for x in v))
    return alpha, beta


@pytest.mark.parametrize("window,short", [(1 << 20, 64), (64, 64), (1 << 20, 4), (50, 1)])
def test_stretches_and_windows_are_exact(monkeypatch, window, short):
    monkeypatch.setattr(lattice, "WINDOW", window)
    monkeypatch.setattr(lattice, "_SHORT", short)
    pieces, rng = lattice.Pieces.load(), random.Random(4)
    weight = dict(zip(pieces.strings, pieces.weights))
    texts = [bytes(rng.choice(b"etaoinsh") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["中文没有空格的文本".encode() * 9, b"a" * 400, b"", b"-" * 300, bytes(range(33, 256))]
    counts = np.array([float(rng.randint(0, 4)) for _ in texts])
    got, used = lattice.word_likelihoods(*lattice._spans(pa.array(texts, pa.binary())), pieces, counts)
    want = Counter()
    for t, c, g in zip(texts, counts, got):
        w = b" " + t
        alpha, beta = _plain(w, weight, pieces.longest)
        assert abs(alpha[-1] - g) < 1e-9 and abs(beta[0] - g) < 1e-9
        for a in range(len(w)):
            for n in range(1, min(pieces.longest, len(w) - a) + 1):
                if w[a : a + n] in weight:
                    want[w[a : a + n]] += c * math.exp(alpha[a] + weight[w[a : a + n]] + beta[a + n] - alpha[-1])
    assert np.allclose(used, [want[s] for s in pieces.strings], atol=1e-9)


def test_scores_of_whole_texts_after_fitting(spark):
    data = [r for r in rows() if r[2:] and len(r[1] or "") < 5000]
    pieces = lattice.Pieces.load()
    weight = dict(zip(pieces.strings, pieces.weights))
    train = [r for r in data if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    counts = Counter(w for r in train for w in words(r[1]))
    used = Counter()
    for word, c in counts.items():
        w = b" " + word.encode()
        alpha, beta = _plain(w, weight, pieces.longest)
        for a in range(len(w)):
            for n in range(1, min(pieces.longest, len(w) - a) + 1):
                if w[a : a + n] in weight:
                    used[w[a : a + n]] += c * math.exp(alpha[a] + weight[w[a : a + n]] + beta[a + n] - alpha[-1])
    total = sum(used.values()) + 1e-3 * len(weight) + len(train)
    fitted = {s: math.log((used[s] + 1e-3) / total) for s in weight}
    end = math.log(len(train) / total)
    cache = {}

    def score(text):
        out = end
        for w in words(text):
            if w not in cache:
                cache[w] = _plain(b" " + w.encode(), fitted, pieces.longest)[0][-1]
            out += cache[w]
        return round(out / math.log(10), 6)

    got = sorted((repr(g.doc_id), round(g.score, 6)) for g in lattice.lattice_scores(table(spark, data), shard_bytes=3000).collect())
    assert got == sorted((repr(r[0]), score(r[1])) for r in data)


def test_equal_rows_are_scored_once(spark, monkeypatch):
    """Rows equal in id and text are one row of a shard, and come out each."""
    same = [(None, "the same words again and again")] * 400 + [(8, None)] * 30 + [(7, "others"), (3, "others"), (3, "once more")]
    df = spark.createDataFrame(same, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lattice, "_STEP", 7)
    d = df.selectExpr("doc_id", "coalesce(text, '') AS text", "true AS train")
    folded, some = lattice._folded(d, len(same))
    assert some and sorted(r.n for r in folded.collect()) == [1, 1, 1, 30, 400]
    got = sorted((tuple(r) for r in lattice.lattice_scores(df).collect()), key=repr)
    monkeypatch.setattr(lattice, "_folded", lambda d, rows: (d.selectExpr("*", "1L AS n"), False))
    want = sorted((tuple(r) for r in lattice.lattice_scores(df).collect()), key=repr)
    assert len(got) == len(want) == 433
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)
