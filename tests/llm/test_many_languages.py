import random

from helpers import table

from lodestone.llm import langmix


def test_three_hundred_values_of_lang(spark):
    """Each is learnt, however few rows it has."""
    rng = random.Random(5)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for _ in range(12)] for i in range(300)}
    data = [(n * 300 + i, " ".join(rng.choice(words[x]) for _ in range(25)), x, None, None, None, None, None) for n in range(2) for i, x in enumerate(sorted(words))]
    langs, p = langmix.fit(table(spark, data))
    assert langs == sorted(words) and p.shape == (300, langmix.BUCKETS) and abs(p.sum(1) - 1).max() < 1e-9
    got = langmix.identify(table(spark, data[:40] + data[300:340])).collect()
    known = {r[2] for r in data[:40] + data[300:340] if not next(g.held_out for g in got if g.doc_id == r[0])}
    for r in got:
        assert r.lang_pred == f"l{r.doc_id % 300:03d}" or f"l{r.doc_id % 300:03d}" not in known


def test_values_without_ngrams_are_learnt(spark):
    langs, p = langmix.fit(table(spark, [(1, "", "aa", None, None, None, None, None), (2, "plain words", "bb", None, None, None, None, None)]))
    assert langs == ["aa", "bb"] and p[0].std() == 0
    assert langmix.fit(table(spark, []))[0] == []
