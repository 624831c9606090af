"""The page-level search against one that ranks the whole pool anew for every
page and profile, and its time on a pool of full size."""

import time

import numpy as np
import pytest

from lodestone.operators import oracle, page_oracle

TOL = oracle.TOLERANCE


def ndcg(scores, relevance):
    gain = 2.0**relevance - 1
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:10]
    weight = [1 / np.log2(i + 2) for i in range(10)]
    ideal = sum(g * w for g, w in zip(sorted(gain, reverse=True), weight))
    return sum(gain[i] * w for i, w in zip(order, weight)) / ideal if ideal else 0.0


def plain(channels, relevance, profiles, best, sweeps=2):
    fused = channels @ profiles.T
    chosen, scores = np.full(len(relevance), best), fused[:, best].copy()
    start, now, updates = ndcg(scores, relevance), ndcg(scores, relevance), 0
    for _ in range(sweeps):
        before = updates
        for page in sorted(range(len(relevance)), key=lambda i: (-fused[i, best], i)):
            pick, value = chosen[page], now
            for i in range(len(profiles)):
                trial = scores.copy()
                trial[page] = fused[page, i]
                if i != chosen[page] and ndcg(trial, relevance) > value + TOL:
                    pick, value = i, ndcg(trial, relevance)
            if pick != chosen[page]:
                chosen[page], scores[page] = pick, fused[page, pick]
                now, updates = ndcg(scores, relevance), updates + 1
        if updates == before:
            break
    return start, now, chosen, updates


@pytest.mark.parametrize("seed", range(24))
def test_search_equals_ranking_anew(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 5, 9, 10, 11, 12, 30][seed % 8]
    # quarters give many ties
    channels = rng.integers(0, 5, (n, 3)) / 4 if seed % 2 else rng.random((n, 3))
    relevance = rng.integers(0, 4, n).astype(float) * (rng.random(n) < 0.5)
    profiles = np.array(oracle.W7)
    best, base, value, chosen, updates = page_oracle.search(channels, relevance, profiles)
    want = plain(channels, relevance, profiles, best)
    if relevance.any():
        assert (base, value) == (pytest.approx(want[0], abs=1e-12), pytest.approx(want[1], abs=1e-12))
        assert chosen.tolist() == want[2].tolist() and updates == want[3]
    else:
        assert (value, updates) == (0.0, 0)


def test_pool_of_full_size():
    rng = np.random.default_rng(1)
    n = 5385
    channels, relevance = rng.random((n, 3)), np.zeros(n)
    relevance[rng.choice(n, 6, replace=False)] = 1
    channels[relevance > 0] += rng.random((6, 3)) / 4
    began = time.perf_counter()
    for grid in (oracle.W7, oracle.simplex(10)):
        _, base, value, _, updates = page_oracle.search(channels, relevance, np.array(grid))
        assert base <= value <= 1 and updates
    took = time.perf_counter() - began
    print(f"\n7 and 66 profiles over {n} pages: {took:.2f} s")
    assert took < 20


def test_query_equals_ranking_anew(spark, sf):
    from lodestone.operators.contracts import CHANNELS
    from lodestone.plans import adapters, catalogue

    pools = {}
    for r in adapters.labelled(spark, sf).select("query_id", "page_id", "relevance", *CHANNELS).collect():
        pools.setdefault(r.query_id, []).append(tuple(r)[1:])
    got = catalogue.queries()["m4_page_oracle"](spark, sf).collect()
    assert {r.query_id for r in got} == set(pools)
    for r in got:
        rows = sorted(pools[r.query_id])
        relevance, channels = np.array([x[1] for x in rows]), np.array([x[2:] for x in rows])
        start, now, chosen, updates = plain(channels, relevance, np.array(oracle.W7), r.query_profile)
        assert (r.query_ndcg10, r.page_ndcg10) == (pytest.approx(start, abs=1e-6), pytest.approx(now, abs=1e-6))
        assert (r.changed, r.updates) == (int((chosen != r.query_profile).sum()), updates)
