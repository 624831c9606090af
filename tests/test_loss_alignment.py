"""Losses of all profiles, from one exchange of the rows."""

import numpy as np
import pandas as pd

from lodestone.operators import gate
from lodestone.operators.contracts import CHANNELS


def one_by_one(pdf, profiles, k):
    pdf, out = pdf.sort_values("page_id"), []
    x, hit = pdf[CHANNELS].to_numpy(float), pdf["relevance"].to_numpy(float) > 0
    for a, b, c in profiles:
        score = x[:, 0] * a + x[:, 1] * b + x[:, 2] * c
        place = {i: n for n, i in enumerate(sorted(range(len(score)), key=lambda i: -score[i]), 1)}
        cut = lambda i: 1 / np.log2(place[i] + 1) if place[i] <= k else 0.0
        pairs = [(np.log1p(np.exp(score[j] - score[i])), abs(cut(i) - cut(j))) for i in np.flatnonzero(hit) for j in np.flatnonzero(~hit)]
        weight = sum(w for _, w in pairs)
        out.append((np.mean([v for v, _ in pairs]), sum(v * w for v, w in pairs) / weight if weight else 0.0))
    return np.array(out)


def test_profiles_together_as_one_by_one(monkeypatch):
    rng, profiles = np.random.default_rng(3), [(1.0, 0.0, 0.0), (0.2, 0.3, 0.5), (0.0, 0.5, 0.5), (1 / 3, 1 / 3, 1 / 3)]
    for n, pairs in ((40, 1 << 18), (40, 500), (3, 1), (25, 1)):
        monkeypatch.setattr(gate, "PAIRS", pairs)
        pdf = pd.DataFrame({"query_id": "q", "page_id": [f"p{i:02d}" for i in rng.permutation(n)], "relevance": [float(i % 3 == 0) for i in range(n)], **{c: rng.integers(0, 5, n) / 4 for c in CHANNELS}})
        got = gate._profile_losses(profiles, 10)(pdf)
        assert np.allclose(got[["plain", "weighted"]].to_numpy(), one_by_one(pdf, profiles, 10), atol=1e-12) and got["profile"].tolist() == [0, 1, 2, 3]
    assert not len(gate._profile_losses(profiles, 10)(pdf.assign(relevance=0.0)))


def test_rows_are_exchanged_once(spark, sf):
    from lodestone.plans.queries_search import n8

    d = n8(spark, sf)
    d.collect()
    assert "ReusedExchange" in d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
