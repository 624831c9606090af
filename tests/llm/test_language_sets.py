import numpy as np
import pytest

from lodestone.llm import langmix


def _models(k, seed=5):
    """Overlapping languages: a common part and one of their own."""
    rng = np.random.default_rng(seed)
    common = rng.gamma(0.3, size=langmix.BUCKETS)
    p = np.stack([0.6 * common / common.sum() + 0.4 * x / x.sum() for x in rng.gamma(0.05, size=(k, langmix.BUCKETS))])
    p += 1e-7
    return p / p.sum(1, keepdims=True)


def _draw(p, shares, n, seed):
    return np.random.default_rng(seed).choice(langmix.BUCKETS, n, p=shares @ p)


def _plain(grams, p):
    """Backward choice by plain EM of very many rounds."""
    gram, count = np.unique(grams, return_counts=True)
    q, langs, best, top = (p / p.mean(0))[:, gram], list(range(len(p))), None, -np.inf
    while langs:
        pi = np.full(len(langs), 1 / len(langs))
        for _ in range(20_000):
            new = pi * (q[langs] @ (count / (pi @ q[langs]))) / len(grams)
            if abs(new - pi).max() < 1e-13:
                break
            pi = new
        value = count @ np.log(pi @ q[langs]) - 0.5 * np.log(len(grams)) * (len(langs) - 1)
        if value < top:
            break
        top, best = value, np.zeros(len(p))
        best[langs] = pi
        langs.pop(len(langs) - 1 - pi[::-1].argmin())
    return best


@pytest.mark.parametrize("n", [300, 20_000, 300_000])
def test_one_language_is_kept_of_four(n):
    p = _models(4)
    for i in range(4):
        shares = langmix.mixtures(np.zeros(n, np.int64), _draw(p, np.eye(4)[i], n, i), 1, p)
        assert shares[0].tolist() == np.eye(4)[i].tolist()


@pytest.mark.parametrize("k", [4, 18])  # more than 16 languages have no Newton steps
def test_choice_against_plain_em(k):
    p = _models(k)
    mixes = np.zeros((6, k))
    mixes[0, 2], mixes[1, :2], mixes[2, 1:4], mixes[3, 0], mixes[4, [0, 3]], mixes[5, 3] = 1, 0.5, 1 / 3, 1, (0.9, 0.1), 1
    sizes = [5, 400, 5000, 2000, 9000, 60]
    drawn = [_draw(p, m, n, i) for i, (m, n) in enumerate(zip(mixes, sizes))]
    got = langmix.mixtures(np.repeat(np.arange(6), sizes), np.concatenate(drawn), 6, p)
    for g, d in zip(got, drawn):
        want = _plain(d, p)
        assert ((g > 0) == (want > 0)).all() and np.allclose(g, want, atol=2e-3), (g, want)


def test_equal_texts_have_equal_shares_in_any_batch():
    p = _models(4)
    texts = [_draw(p, np.array([0.5, 0.3, 0.2, 0]), n, n) for n in (700, 690, 710, 650, 720)]
    alone = langmix.mixtures(np.zeros(700, np.int64), texts[0], 1, p)[0]
    both = langmix.mixtures(np.repeat(np.arange(6), [len(t) for t in [*texts[1:], texts[0], texts[0]]]), np.concatenate([*texts[1:], texts[0], texts[0]]), 6, p)
    assert both[4].tolist() == both[5].tolist() == alone.tolist()


def test_equal_languages_go_to_the_first():
    p = _models(2)[[0, 0, 1]]
    assert langmix.mixtures(np.zeros(900, np.int64), _draw(p, np.array([1, 0, 0]), 900, 1), 1, p)[0].tolist() == [1, 0, 0]
